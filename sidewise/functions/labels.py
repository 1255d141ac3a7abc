"""Derived labels and numbers shown next to a comparison: deltas, directions, vocabulary, top-k labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two vocabularies for the category of a change, first form to second form.
CHANGE_CATEGORIES = {
    "breaking": "model_wide",
    "partial_breaking": "column",
    "non_breaking": "additive",
    "unknown": "unknown",
}

# Labels for categories that have no text of their own.
NULL_LABEL, EMPTY_LABEL, OTHERS_LABEL = "(null)", "(empty)", "(others)"


def delta_label(base: Column, current: Column) -> Column:
    """Relative change against base as text: ``+10.0%``, ``- <0.1 %``, ``0``, ``N/A``, ``Added``, ``Removed``."""
    share = F.try_divide(F.abs(current - base).cast("double"), base.cast("double")) * 100
    size = F.when(share >= 0.1, F.format_string("%.1f", share)).otherwise(F.lit(" <0.1 "))
    return (
        F.when(base.isNull() & current.isNull(), "N/A")
        .when(base.isNull(), "Added")
        .when(current.isNull(), "Removed")
        .when(base == current, "0")
        .when(base == 0, "N/A")
        .otherwise(F.concat(F.when(base < current, "+").otherwise("-"), size, F.lit("%")))
    )


def direction(base: Column, current: Column) -> Column:
    """How a count moved; presence words describe the table, the others the quantity."""
    return (
        F.when(base.isNull() & current.isNull(), "unavailable")
        .when(base.isNull(), "added")
        .when(current.isNull(), "removed")
        .when(current > base, "increase")
        .when(current < base, "decrease")
        .otherwise("unchanged")
    )


def presence_status(base: Column, current: Column) -> Column:
    """added, removed, modified, or NULL when both are equal or both are missing."""
    return (
        F.when(base.isNull() & current.isNotNull(), "added")
        .when(base.isNotNull() & current.isNull(), "removed")
        .when(base != current, "modified")
    )


def delta_pct_of_base(base: Column, current: Column) -> Column:
    """Change in percent of base, one decimal; NULL when base is zero or a side is missing."""
    return F.round(F.try_divide((current - base).cast("double"), base.cast("double")) * 100, 1)


def delta_pct_of_current(base: Column, current: Column) -> Column:
    """Change in percent of current, two decimals; NULL when nothing changed or current is zero."""
    pct = F.round(F.try_divide((current - base).cast("double"), current.cast("double")) * 100, 2)
    return F.when(base != current, pct)


def normalize_category(category: Column) -> Column:
    """A change category in the first vocabulary, whichever one it came in; unknown words pass through."""
    return _translate(category, {new: old for old, new in CHANGE_CATEGORIES.items()})


def renamed_category(category: Column) -> Column:
    """A change category in the second vocabulary; unknown words pass through."""
    return _translate(category, CHANGE_CATEGORIES)


def category_label(value: Column) -> Column:
    """Text of a top-k category, with words for NULL and the empty string."""
    return F.when(value.isNull(), NULL_LABEL).when(value == "", EMPTY_LABEL).otherwise(value)


def _translate(value: Column, words: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(word) for pair in words.items() for word in pair])
    return F.coalesce(pairs[value], value)
