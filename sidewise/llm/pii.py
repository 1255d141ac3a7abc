"""Personal data in texts: fixed patterns, and further spans by weak supervision.

1. *Base spans* come from four patterns with their checks: email, ip, card, phone. They always stay.
2. *Candidates* are wider: numbers, masked addresses and titled names that no base span touches. Three labelers vote on
   each: a format labeler (patterns and check digits), a gazetteer labeler (words before it, in four languages) and a
   context labeler (how it stands in its sentence).
3. Expectation maximisation over the counts of vote patterns estimates how reliable each labeler is, and with that how
   likely each pattern marks personal data.
4. These likelihoods train the final classifier (naive Bayes over hashed features of a candidate), which decides.

Everything runs on DataFrame functions. Texts are read once and never shuffled. The driver sees the counts of vote patterns
(27 per kind at most) and feature sums (``FEATURES`` per kind at most), both over all documents.

Positions count code points, ends are exclusive. Defined results: a null text is an empty one and has no spans; every row
has its result whatever its id; an empty table yields no rows; columns of any name are carried along.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.llm.common import quoted
from sidewise.plans.storage import cut

# The base kinds in their order and their patterns. Possessive repeats and the look-behinds change no match
# (what may follow never belongs to what is repeated, and a match cannot start inside a run that failed as a whole); they
# keep the time linear in long runs. The card pattern holds the runs with 12 to 19 digits only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Gazetteers: titles, and words before a number that speak for or against personal data (English, German, French, Spanish).
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
PERSONAL = (
    "phone telephone tel mobile call fax card account iban passport ssn contact telefon handy konto karte ausweis kontakt "
    "téléphone portable compte carte passeport teléfono móvil cuenta tarjeta pasaporte contacto"
).split()
IMPERSONAL = (
    "page pages isbn issn version chapter figure table section year seite kapitel abbildung tabelle jahr chapitre tableau "
    "année página capítulo figura tabla año"
).split()
CANDIDATES = {
    "number": r"(?<![0-9A-Za-z+])(?<![0-9][\x20.-])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "handle": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,24}+)",
    "name": r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?",
}
KINDS = (*BASE, *CANDIDATES)
FEATURES = 256
CONTEXT = 40
# Hits of a text are walked in parts of so many, so that the time grows little faster than their number.
PART = 128
VOTERS = ("format", "gazetteer", "context")


def extracted(docs: DataFrame, text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` with ``base`` spans and ``candidates`` of every row, stored."""
    rows = docs.select(
        *[docs[quoted(name)].alias(f"c{i}") for i, name in enumerate(keep)],
        F.coalesce(docs[quoted(text_column)], F.lit("")).alias("__text"),
    )
    kept = [f"c{i}" for i in range(len(keep))]
    patterns = BASE | CANDIDATES
    hits = rows.select(*kept, "__text", *[_hits(kind, pattern).alias(kind) for kind, pattern in patterns.items()])
    # Each step on its own, so that what the next one uses twice is computed once.
    paired = hits.select(*kept, *[_paired(kind, pattern).alias(kind) for kind, pattern in patterns.items()])
    parted = paired.select(*kept, *[_parts(F.col(kind)).alias(kind) for kind in patterns])
    begun = parted.select(*kept, *patterns, *[_starts(F.col(kind), _length).alias(f"__{kind}") for kind in patterns])
    placed = begun.select(*kept, *[_placed(kind).alias(kind) for kind in patterns])
    base = F.array_sort(F.concat(*[_spans(kind, _checked(kind)) for kind in BASE]))
    based = placed.select(*kept, base.alias("base"), *[_parts(F.col(kind)).alias(kind) for kind in CANDIDATES])
    free = based.select(*kept, "base", *[_free(kind).alias(kind) for kind in CANDIDATES])
    return cut(free.select(*kept, "base", F.concat(*[_voted(kind) for kind in CANDIDATES]).alias("candidates")), "pii")


def _hits(kind: str, pattern: str) -> Column:
    """The matched strings. Texts without a needed character skip the pattern."""
    text = F.col("__text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    needed = {"email": ["@"], "phone": ["+"], "handle": ["at)", "at]"]}.get(kind)
    if needed is None:
        return found
    possible = text.contains(needed[0])
    for other in needed[1:]:
        possible = possible | text.contains(other)
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def _paired(kind: str, pattern: str) -> Column:
    """``array<struct<gap, width, hit, before, after>>``: matches with the lengths of the text before them and their own."""
    gaps = F.split(F.col("__text"), pattern, -1)
    pairs = F.zip_with(
        F.zip_with(gaps, F.col(kind), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))),
        F.slice(gaps, 2, F.size(F.col(kind)) + 1),
        lambda pair, after: F.struct(
            F.char_length(pair["gap"]).alias("gap"),
            F.char_length(pair["hit"]).alias("width"),
            pair["hit"].alias("hit"),
            F.substring(pair["gap"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(after, 1, 1).alias("after"),
        ),
    )
    empty = F.array().cast("array<struct<gap:int,width:int,hit:string,before:string,after:string>>")
    return F.when(F.size(kind) > 0, F.filter(pairs, lambda pair: pair["hit"].isNotNull())).otherwise(empty)


def _parts(array: Column) -> Column:
    """An array cut into parts of ``PART`` elements; one empty part if it is empty."""
    last = F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / PART).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(array, i * PART + 1, PART))


def _length(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda total, pair: total + pair["gap"] + pair["width"])


def _starts(parts: Column, length: Callable[[Column], Column]) -> Column:
    """The position at which each part starts, from the lengths of the parts before."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        F.transform(parts, length),
        begin,
        lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all")),
        lambda state: state["all"],
    )


def _placed(kind: str) -> Column:
    """``array<struct<start, end, hit, before, after>>``: places follow from the lengths of what lies between matches."""
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + pair["gap"]
        end = first + pair["width"]
        span = F.struct(
            first.alias("start"), end.alias("end"), pair["hit"].alias("hit"), pair["before"].alias("before"),
            pair["after"].alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def part(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), empty.alias("found")), step, lambda state: state["found"])

    return F.flatten(F.zip_with(kind, f"__{kind}", part))


def _free(kind: str) -> Column:
    """The candidates that touch no base span. Each part of them is compared with the base spans between its ends only."""

    def meets(span: Column, start: Column, end: Column) -> Column:
        return (span["start"] < end) & (start < span["end"])

    def nearby(part: Column) -> Column:
        first, last = F.get(part, F.lit(0))["start"], F.get(part, F.size(part) - 1)["end"]
        return F.struct(part.alias("part"), F.filter("base", lambda b: meets(b, first, last)).alias("base"))

    pairs = F.transform(kind, nearby)
    kept = F.transform(
        pairs, lambda p: F.filter(p["part"], lambda s: ~F.exists(p["base"], lambda b: meets(b, s["start"], s["end"])))
    )
    return F.flatten(kept)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.split(F.reverse(_digits(text)), "")
    values = F.transform(digits, lambda d, i: d.cast("int") * (i % 2 + 1))
    total = F.aggregate(values, F.lit(0), lambda sum_, v: sum_ + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _checked(kind: str) -> Column:
    """Base matches that pass their check; those that fail are dropped."""
    checks: dict[str, Callable[[Column], Column]] = {
        "ip": lambda s: s["hit"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda s: _luhn(s["hit"]),
        "phone": lambda s: F.length(_digits(s["hit"])).between(9, 15),
    }
    return F.filter(kind, checks[kind]) if kind in checks else F.col(kind)


def _spans(kind: str, spans: Column) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"))
    )


def _words(words: Sequence[str]) -> str:
    return r"(?i)(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"


def _voted(kind: str) -> Column:
    """Candidates with their votes (1 for, -1 against, 0 none) and features."""
    digits = lambda s: F.length(_digits(s["hit"]))

    def form(s: Column) -> Column:
        if kind == "number":
            grouped = s["hit"].rlike(r"^[0-9]{2,4}[)\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{3,4}$")
            wrong = (digits(s).between(12, 19) & ~_luhn(s["hit"])) | s["hit"].rlike(r"^[0-9]{1,4}[.-][0-9]{1,2}[.-][0-9]{1,4}$")
            return F.when(wrong, -1).when(grouped, 1).otherwise(0)
        if kind == "handle":
            return F.when(s["hit"].rlike(r"[(\[]dot[)\]]"), 1).otherwise(0)
        return F.when(s["hit"].rlike(r"\x20\p{Lu}\p{L}+\x20\p{Lu}"), 1).otherwise(0)

    def words(s: Column) -> Column:
        return (
            F.when(s["before"].rlike(_words(PERSONAL)), 1).when(s["before"].rlike(_words(IMPERSONAL)), -1).otherwise(0)
        )

    def place(s: Column) -> Column:
        introduced = s["before"].rlike(r"[:=(#]\s*$")
        inside_prose = s["before"].rlike(r"\p{L}\s$") & s["after"].rlike(r"^[\s,]")
        return F.when(introduced, 1).when(inside_prose, -1).otherwise(0)

    def features(s: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(s["hit"], "[0-9]+", "9"), r"\p{L}+", "a")
        last_word = F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))
        named = F.array(
            F.concat(F.lit("shape "), shape),
            F.concat(F.lit("digits "), digits(s).cast("string")),
            F.concat(F.lit("word "), last_word),
            F.concat(F.lit("after "), s["after"]),
            *[F.concat(F.lit(f"{name} "), vote(s).cast("string")) for name, vote in zip(VOTERS, (form, words, place))],
        )
        return F.transform(named, lambda f: F.pmod(F.xxhash64(f), F.lit(FEATURES)).cast("int"))

    return F.transform(
        kind,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
            F.array(form(s), words(s), place(s)).alias("votes"), features(s).alias("features"),
        ),
    )


def label_model(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Probability of the positive class for each vote pattern, by expectation maximisation over pattern counts.

    Each labeler votes 1, 0 or -1 with its own probabilities given the class. The start takes the mean vote, and small
    pseudo-counts in favour of the labelers keep them better than chance.
    """
    pseudo = {(vote, label): 2.0 if vote == label else 1.0 for vote in (-1, 0, 1) for label in (-1, 1)}
    odds = {votes: 0.5 + 0.4 * sum(votes) / len(votes) for votes, _ in patterns}
    for _ in range(rounds):
        prior = {1: 1.0, -1: 1.0}
        tables = [dict(pseudo) for _ in patterns[0][0]] if patterns else []
        for votes, count in patterns:
            for label, share in ((1, odds[votes]), (-1, 1 - odds[votes])):
                prior[label] += count * share
                for table, vote in zip(tables, votes):
                    table[vote, label] += count * share
        for votes, _ in patterns:
            logs = {}
            for label in (1, -1):
                logs[label] = math.log(prior[label])
                for table, vote in zip(tables, votes):
                    logs[label] += math.log(table[vote, label] / sum(table[v, label] for v in (-1, 0, 1)))
            odds[votes] = 1 / (1 + math.exp(min(700, logs[-1] - logs[1])))
    return odds


def train(found: DataFrame) -> dict[str, list[float]]:
    """Weights of the final classifier by kind: the prior log-odds, then one weight per feature."""
    spans = found.select(F.explode("candidates").alias("s")).select("s.kind", "s.votes", "s.features")
    counted: dict[int, list] = {}
    for row in spans.groupBy("kind", "votes").count().collect():
        counted.setdefault(row["kind"], []).append((tuple(row["votes"]), row["count"]))
    models = {kind: label_model(patterns) for kind, patterns in counted.items()}
    likely = F.lit(0.0)
    for kind, model in models.items():
        for votes, p in model.items():
            same = (F.col("kind") == kind) & (F.col("votes") == F.array(*[F.lit(v) for v in votes]))
            likely = F.when(same, F.lit(p)).otherwise(likely)
    soft = spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).withColumn("p", likely)
    sums = (
        soft.select("kind", F.explode("features").alias("feature"), (F.col("n") * F.col("p")).alias("yes"),
                    (F.col("n") * (1 - F.col("p"))).alias("no"))
        .groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    )
    weights: dict[str, list[float]] = {}
    for kind, model in models.items():
        yes = sum(count * model[votes] for votes, count in counted[kind])
        no = sum(count * (1 - model[votes]) for votes, count in counted[kind])
        weights[KINDS[kind]] = [math.log((yes + 1) / (no + 1)), *[math.log((no + 2) / (yes + 2))] * FEATURES]
    for row in sums.collect():
        own = weights[KINDS[row["kind"]]]
        own[1 + row["feature"]] += math.log((row["yes"] + 1) / (row["no"] + 1))
    return weights


def with_spans(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """Replaces ``candidates`` by ``spans``: base spans and the candidates that the classifier takes, in order."""
    accepted = F.lit(False)

    def score(c: Column, own: list[float]) -> Column:
        table = F.from_json(F.lit(json.dumps(own)), "array<double>")  # one constant
        return F.aggregate(c["features"], F.lit(own[0]), lambda total, f: total + F.element_at(table, f + 2))

    def taken(c: Column) -> Column:
        result = accepted
        for kind, own in weights.items():
            result = F.when(c["kind"] == KINDS.index(kind), score(c, own) > 0).otherwise(result)
        return result

    added = F.transform(
        F.filter("candidates", taken), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    )
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates")


def find_personal_data(docs: DataFrame, text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` with ``base`` and ``spans`` (``array<struct<start, kind, end>>``, kind as index of ``KINDS``).

    Kept columns come back as ``c0``, ``c1`` and so on, so that their names cannot clash.
    """
    found = extracted(docs, text_column, keep)
    return with_spans(found, train(found))


def described(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one. Null texts stay null."""
    names = docs.columns
    found = find_personal_data(docs, text_column, names)
    text = F.col(f"c{names.index(text_column)}")
    kinds = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    parted = found.withColumn("__parts", _parts(F.col("spans")))
    # How far the spans of each part reach, those before it included; the text of a part goes from one such place to the next.
    ends = F.transform("__parts", lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,to:int>>").alias("all"))

    def reach(state: Column, end: Column) -> Column:
        to = F.greatest(state["at"], end)
        pair = F.array(F.struct(state["at"].alias("at"), to.alias("to")))
        return F.struct(to.alias("at"), F.concat(state["all"], pair).alias("all"))

    reached = parted.withColumn("__reach", F.aggregate(ends, begin, reach, lambda state: state["all"]))
    texts = F.transform(
        "__reach", lambda r: F.struct(r["at"].alias("at"), F.substring(text, r["at"] + 1, r["to"] - r["at"]).alias("text"))
    )
    with_texts = reached.withColumn("__texts", texts)

    def masked_part(spans: Column, own: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            between = F.substring(own["text"], state["at"] - own["at"] + 1, s["start"] - state["at"])
            pieces = F.concat(state["pieces"], F.array(between, F.element_at(kinds, s["kind"] + 1)))
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(s["start"] >= state["at"], pieces).otherwise(state["pieces"]).alias("pieces"),
            )

        start = F.struct(own["at"].alias("at"), F.array().cast("array<string>").alias("pieces"))
        return F.aggregate(spans, start, step, lambda state: F.array_join(state["pieces"], ""))

    rest = F.substring(text, F.element_at("__reach", -1)["to"] + 1, F.char_length(text))
    whole = F.concat(F.array_join(F.zip_with("__parts", "__texts", masked_part), ""), rest)
    masked = F.when(F.size("spans") > 0, whole).otherwise(text)
    return with_texts.select(
        *[(masked if name == text_column else F.col(f"c{i}")).alias(name) for i, name in enumerate(names)]
    )
