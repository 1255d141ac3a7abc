"""Fill-in-the-middle examples: texts cut at unit borders and put together anew around sentinels.

A text of n units is cut twice, after the smaller and the larger of two draws from 0 to n; the draws come from a hash of the
document's id, so that a retried task cuts alike. The parts leave in the order prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``), each behind its sentinel, or the text stays as it is (``plain``).

The cuts are found without decoding. The UTF-8 bytes of a batch are viewed as 64-bit words, and a few arithmetic steps
on all words mark the bytes that end a unit. Counting the marks of each word and summing up gives rank (how many marks lie
before a byte) and, by a search in the sums, the word that holds the mark wanted; the place within the word is found by clearing
lower marks. Marks of the first bytes of code points give lengths in code points the same way.

Units are ``line`` (up to and with a line feed; what follows the last line feed is a unit too) or ``character``.

Defined results: a null text is an empty one and stays plain with no units; a text that holds a sentinel stays plain, so that
``restored`` always gives the text back; a null id draws like an empty one; rows of equal id are cut alike and each kept; very
long texts need about three times their size in one task; an empty table yields no rows. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sidewise.llm.common import only, slices

BATCH_BYTES = 8 << 20
LINE, CHARACTER = "line", "character"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _every(byte: int) -> np.uint64:
    """A word with this value in each of its bytes."""
    return np.uint64(byte * 0x0101010101010101)


_HIGH, _LOW_BITS, _LINE_FEEDS = _every(0x80), _every(0x7F), _every(0x0A)
_ONE, _BYTE, _TOP_BYTE = np.uint64(1), np.uint64(8), np.uint64(56)


class Marks:
    """Bytes marked by their high bit in 64-bit words, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each byte position."""
        word = at >> 3
        below = (_ONE << ((at & 7) << 3).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The position of the marked byte of each number, counted from 1."""
        word = np.searchsorted(self.before, number, side="left") - 1
        lower = number - self.before[word] - 1
        held = self.words[word]
        for i in range(7):
            held = np.where(lower > i, held & (held - _ONE), held)
        below = (held & (~held + _ONE)) - _ONE
        return (word << 3) + (np.bitwise_count(below) >> 3)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with at least one byte of padding."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def line_ends(words: np.ndarray) -> Marks:
    different = words ^ _LINE_FEEDS
    # A byte's high bit is clear here only where the byte is zero; no carry crosses a byte.
    return Marks(~(((different & _LOW_BITS) + _LOW_BITS) | different) & _HIGH)


def character_starts(words: np.ndarray) -> Marks:
    """Bytes other than those of the form 10xxxxxx; padding counts as well."""
    return Marks((~words | (words << _ONE)) & _HIGH)


def character_ends(starts: Marks) -> Marks:
    """Bytes before a first byte: the marks one byte on."""
    following = np.append(starts.words[1:], _HIGH)
    return Marks((starts.words >> _BYTE) | (following << _TOP_BYTE) & _HIGH)


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    unit: str = LINE,
    percent: int = 100,
    spm_percent: int = 50,
    seed: int = 7,
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row: units, form, code points of the parts, and the example.

    ``percent`` of the texts are cut, and of those ``spm_percent`` leave as ``spm``.
    """
    if unit not in (LINE, CHARACTER):
        raise ValueError(f"A unit is {LINE!r} or {CHARACTER!r}, not {unit!r}")
    check_sentinels(sentinels)
    rows = only(docs, id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    stays = (F.col("text") == "") | (draw[2] % 100 >= percent)
    for sentinel in sentinels:
        stays |= F.contains("text", F.lit(sentinel))
    form = F.when(stays, PLAIN).when(draw[3] % 100 < spm_percent, SPM).otherwise(PSM)
    drawn = rows.select("id", "text", draw[0].alias("first"), draw[1].alias("second"), form.alias("form"))
    kind = rows.schema["id"].dataType
    schema = pa.schema(
        [
            ("id", to_arrow_type(kind)), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64()), ("output", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(_examples(batch, unit, sentinels), schema=schema)

    return drawn.mapInArrow(
        run, f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def check_sentinels(sentinels: Sentinels) -> None:
    """Sentinels must be found in an output exactly where they were put.

    That holds if none contains another and their first characters occur in none but at the start: a sentinel then
    overlaps neither another one nor the text beside it.
    """
    firsts = {s[:1] for s in sentinels}
    inside = any(s != other and s in other for s in sentinels for other in sentinels)
    if not all(sentinels) or len(set(sentinels)) < 3 or inside or any(c in firsts for s in sentinels for c in s[1:]):
        raise ValueError(f"Sentinels could be mistaken in an output: {tuple(sentinels)}")


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text of an example, from its output and form."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    prefix, suffix, middle = sentinels
    last = F.substring_index(output, middle, -1)
    psm = F.concat(between(prefix, suffix), last, between(suffix, middle))
    spm = F.concat(between(prefix, middle), last, between(suffix, prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def _examples(batch: pa.RecordBatch, unit: str, sentinels: Sentinels) -> list[pa.Array]:
    data, borders = _bytes_of(batch.column("text"))
    words = as_words(data)
    starts = character_starts(words)
    ends = line_ends(words) if unit == LINE else character_ends(starts)
    begin, stop = borders[:-1], borders[1:]
    before = ends.rank(begin)
    marked = ends.rank(stop) - before
    # What follows the last mark of a text is a unit as well.
    last = ends.rank(np.maximum(stop - 1, begin)) - before
    n = marked + ((stop > begin) & (last == marked))
    first, second = (batch.column(c).to_numpy() % (n + 1) for c in ("first", "second"))
    cuts = []
    for units in (np.minimum(first, second), np.maximum(first, second)):
        at = np.where(units > marked, stop, begin)
        inside = np.flatnonzero((units > 0) & (units <= marked))
        at[inside] = ends.select(before[inside] + units[inside]) + 1
        cuts.append(at)
    forms = batch.column("form").to_pylist()
    plain = np.array([form == PLAIN for form in forms], bool)
    chars = [starts.rank(at) for at in (begin, *cuts)]
    raw = data.tobytes()
    p, s, m = (sentinel.encode() for sentinel in sentinels)
    outputs = []
    for form, a, b, c, d in zip(forms, begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), stop.tolist()):
        if form == PLAIN:
            outputs.append(raw[a:d])
        elif form == PSM:
            outputs.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            outputs.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    return [
        batch.column("id"),
        pa.array(n),
        batch.column("form"),
        pa.array(chars[1] - chars[0], mask=plain),
        pa.array(chars[2] - chars[1], mask=plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after another, and their borders."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[borders[0] : borders[-1]], borders - borders[0]
