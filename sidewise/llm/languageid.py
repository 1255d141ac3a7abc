"""Language identification with a linear-chain conditional random field over words.

Every word has a label. Its emission weights are the sum of the weights of its features: the word itself (a learned lexicon),
prefixes and suffixes, character n-grams. Transition weights say how languages follow each other, so a foreign quotation
inside a text is labelled as such. Forward-backward gives each word's label probabilities; a text's language is the one with
the largest mean probability, which is its score.

Training uses a bounded sample: ``SAMPLE_DOCUMENTS`` distinct labelled texts per language, those of the smallest hashes, or all
if there are fewer (so every language whose labelled texts have letters is learned, however many copies they have), with at most ``SAMPLE_RUNS`` runs of ``RUN_WORDS`` words each. Runs of different languages are joined to
code-switched training sequences, from which the transitions are learned. The model is a few hundred kilobytes.

Applying it is one pass over the texts. Emissions are computed once per distinct word and kept; all texts of a batch form one
chain that is reset at each text, and forward-backward runs over blocks of the chain side by side, so a very long text
costs no more per word than a short one.

Defined results: texts that are null or have no letters are ``und`` with score 0; documents without label teach nothing;
without any labelled document every text is ``und``; an empty table yields no rows; columns of any name are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sidewise.llm.common import held_by, quoted, slices
from sidewise.plans.storage import cut

UNDETERMINED = "und"
SAMPLE_DOCUMENTS, SAMPLE_RUNS, RUN_WORDS = 400, 6, 30
FEATURES = 1 << 14
ROUNDS = 60
# Forward-backward holds some 200 bytes for each byte of a batch.
BATCH_BYTES = 2 << 20
_CACHED_WORDS = 300_000
_CACHED_PIECES = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_find_words = _WORD.findall


def has_letter(word: str) -> bool:
    """Python counts number signs such as fractions and Roman numerals among word characters; they are no letters."""
    return word.isalpha() or any(map(str.isalpha, word))


def words_of(text: str) -> list[str]:
    """The lower-case words of a text: runs of letters and number signs with a letter at least."""
    return [word for word in _find_words(text.lower()) if has_letter(word)]


class _Hashed(dict):
    """Feature numbers of the pieces of words, hashed once per piece."""

    def __init__(self, tag: str):
        super().__init__()
        self._tag = tag

    def __missing__(self, piece: str) -> int:
        if len(self) > _CACHED_PIECES:
            self.clear()
        found = self[piece] = zlib.crc32((self._tag + piece).encode("utf-8", "surrogatepass")) % FEATURES
        return found


def _numbers() -> tuple:
    """Look-ups of the feature numbers of prefixes, suffixes and n-grams that this worker has met."""
    return held_by("language features", lambda: tuple(_Hashed(tag).__getitem__ for tag in "psn"))


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    _prefix, _suffix, _gram = _numbers()
    edged = f"^{word}$"
    n = len(edged)
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES]
    found += [_prefix(word[:1]), _prefix(word[:2]), _prefix(word[:3])]
    found += [_suffix(word[-1:]), _suffix(word[-2:]), _suffix(word[-3:])]
    found += [_gram(edged[i : i + 2]) for i in range(n - 1)]
    found += [_gram(edged[i : i + 3]) for i in range(n - 2)]
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages, from row to column
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission weights of words, one row each. Long words have the mean of their features, so that weights compare."""
        flat: list[int] = []
        counts = []
        for word in words:
            own = features(word)
            flat += own
            counts.append(len(own))
        starts = np.cumsum([0, *counts[:-1]])
        return np.add.reduceat(self.weights[flat], starts, axis=0) * (10 / np.array(counts, np.float32))[:, None]


def marginals(
    emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, training: bool = True
) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over one long chain that is reset wherever ``first`` is set.

    Returns label probabilities per word and, for training, the expected transitions (summed) and the log-likelihood normaliser.

    The chain is cut into blocks of about the square root of its length. Block products of the step matrices give the
    vectors at all block borders, and with those all blocks run side by side. A reset is a step matrix with equal rows.
    """
    n, k = emissions.shape
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    top = emissions.max(axis=1, keepdims=True)
    e = np.exp((emissions - top).astype(np.float64))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, width, k)
    resets = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, width)
    follow, begin = np.exp(transitions.astype(np.float64)), np.exp(start.astype(np.float64))
    log = float(top.sum())

    def step(vectors: np.ndarray, i: int) -> np.ndarray:
        moved = np.where(resets[:, i, None], begin, vectors @ follow)
        return moved * e[:, i]

    # Products of the blocks: what becomes of each label at the border before.
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(width):
        moved = (product.reshape(-1, k) @ follow).reshape(blocks, k, k)
        again = resets[:, i]
        moved[again] = product[again].sum(axis=2, keepdims=True) * begin
        product = moved * e[:, i][:, None, :]
        if i % 8 == 7:
            product /= product.max(axis=(1, 2), keepdims=True)
    product /= product.max(axis=(1, 2), keepdims=True)
    border = np.empty((blocks, k))
    vector = np.full(k, 1.0 / k)
    for b in range(blocks):
        border[b] = vector
        vector = vector @ product[b]
        vector /= vector.sum()
    back = np.empty((blocks, k))
    vector = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        back[b] = vector
        vector = product[b] @ vector
        vector /= vector.sum()

    alpha = np.empty((blocks, width, k))
    vectors = border
    for i in range(width):
        vectors = step(vectors, i)
        scale = vectors.sum(axis=1, keepdims=True)
        vectors = vectors / scale
        alpha[:, i] = vectors
        if training:
            log += float(np.log(scale).sum())
    log -= pad * float(np.log(begin.sum()))
    beta = np.empty((blocks, width, k))
    vectors = back
    expected = np.zeros((k, k))
    for i in range(width - 1, -1, -1):
        beta[:, i] = vectors
        onward = e[:, i] * vectors
        if training:
            before = alpha[:, i - 1] if i else border
            inside = ~resets[:, i]
            joint = before[inside][:, :, None] * follow * onward[inside][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint.sum(axis=0)
        vectors = np.where(resets[:, i, None], 1.0, onward @ follow.T)
        vectors = vectors / vectors.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=2, keepdims=True)
    return both.reshape(-1, k)[:n], expected, log


def label_probabilities(model: Model, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
    return marginals(emissions, first, model.transitions, model.start, training=False)[0]


def train_model(runs: list[tuple[str, list[str]]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit the field to runs of words of one language each, joined to code-switched sequences."""
    languages = sorted({language for language, _ in runs})
    k = len(languages)
    generator = np.random.Generator(np.random.PCG64(seed))
    order = generator.permutation(len(runs))
    words: dict[str, int] = {}
    ids, labels, first = [], [], []
    for place, i in enumerate(order):
        language, run = runs[i]
        for at, word in enumerate(run):
            # Three runs to a sequence.
            first.append(place % 3 == 0 and at == 0)
            ids.append(words.setdefault(word, len(words)))
            labels.append(languages.index(language))
    if not ids:
        return Model(languages, np.zeros((FEATURES, k), np.float32), np.zeros((k, k)), np.zeros(k))
    first[0] = True
    ids, labels, first = np.array(ids), np.array(labels), np.array(first)
    lists = [features(word) for word in words]
    flat = np.array([f for own in lists for f in own])
    owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    share = (10.0 / np.array([len(own) for own in lists]))[owner]
    truth = np.zeros((len(words), k))
    np.add.at(truth, (ids, labels), 1.0)
    seen = np.zeros((k, k))
    inside = ~first[1:]
    np.add.at(seen, (labels[:-1][inside], labels[1:][inside]), 1.0)
    begun = np.bincount(labels[first], minlength=k).astype(float)
    weights, transitions, start = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(w, 1e-8) for w in (weights, transitions, start)]
    for turn in range(rounds):
        emission = np.stack([np.bincount(owner, weights[flat, c] * share, len(words)) for c in range(k)], axis=1)
        probable, expected, _ = marginals(emission[ids], first, transitions, start)
        model = np.stack([np.bincount(ids, probable[:, c], len(words)) for c in range(k)], axis=1)
        by_word = (truth - model)[owner] * share[:, None]
        gradients = (
            np.stack([np.bincount(flat, by_word[:, c], FEATURES) for c in range(k)], axis=1) - 0.5 * weights,
            seen - expected - 0.5 * transitions,
            begun - probable[first].sum(axis=0) - 0.5 * start,
        )
        rate = 0.15 * (1 - turn / rounds) + 0.01
        for value, square, gradient in zip((weights, transitions, start), squares, gradients):
            square *= 0.9
            square += 0.1 * gradient**2
            value += rate * gradient / np.sqrt(square)
    return Model(languages, weights.astype(np.float32), transitions, start)


def sample_runs(docs: DataFrame, text_column: str, lang_column: str, may_learn: Column | None = None) -> list[tuple[str, list[str]]]:
    """Runs of words of a bounded sample of labelled texts, spread evenly over each sampled text."""
    rows = docs.filter(may_learn) if may_learn is not None else docs
    rows = rows.select(rows[quoted(lang_column)].alias("lang"), rows[quoted(text_column)].alias("text"))
    # Texts without letters have no words to learn from.
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.xxhash64("text", F.lit(11)))
    # Drawn among distinct texts: copies are merged before the shuffle and neither count nor displace others.
    pairs = cut(rows.select("lang", "draw").distinct(), "draws")
    counts = {row["lang"]: row["count"] for row in pairs.groupBy("lang").count().collect()}
    # Twice the wanted number is surely enough for the smallest draws and leaves the window few rows at any size.
    few = F.lit(False)
    for language, count in counts.items():
        limit = min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE_DOCUMENTS // count) - (1 << 63)
        few = F.when(F.col("lang") == language, F.col("draw") <= F.lit(limit)).otherwise(few)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = pairs.filter(few).withColumn("place", place).filter(F.col("place") <= SAMPLE_DOCUMENTS).select("lang", "draw")
    chosen = rows.join(F.broadcast(drawn), ["lang", "draw"], "left_semi").groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            languages, runs = [], []
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                starts = range(0, len(words), RUN_WORDS)
                step = max(1, -(-len(starts) // SAMPLE_RUNS))
                for at in starts[::step]:
                    languages.append(language)
                    runs.append(words[at : at + RUN_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), pa.array(runs, pa.list_(pa.string()))], ["lang", "run"]
            )

    taken = chosen.select("lang", "text").mapInArrow(run, "lang string, run array<string>").distinct().collect()
    return sorted((row["lang"], row["run"]) for row in taken if row["run"])


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", may_learn: Column | None = None) -> Model:
    return train_model(sample_runs(docs, text_column, lang_column, may_learn))


class _Emissions(dict):
    """Place of each word in a growing table of emissions; -1 for what has no letter."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.words = 0

    def __missing__(self, word: str) -> int:
        if not has_letter(word):
            self[word] = -1
            return -1
        place = self[word] = self.words
        self.words += 1
        self.new.append(word)
        return place


def identify(docs: DataFrame, model: Model, text_column: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``; with ``spans`` also ``__spans``: runs of words of one language.

    A span is ``start, end, lang`` with positions in code points, from the first letter of its first word to the end of its
    last one.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text = columns[docs.columns.index(text_column)]
    plain = docs.toDF(*columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    extra = ", found_spans array<struct<start:int,end:int,lang:string>>" if spans else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = _Emissions(), np.empty((0, len(model.languages)), np.float32)
        for batch in slices(batches, text, BATCH_BYTES):
            if len(places) > _CACHED_WORDS:
                places, table = _Emissions(), table[:0]
            texts = [t or "" for t in batch.column(text).to_pylist()]
            if model.languages:
                found = [np.array(list(map(places.__getitem__, _find_words(t.lower()))), np.int32) for t in texts]
                found = [own if own.min(initial=0) >= 0 else own[own >= 0] for own in found]
            else:
                found = [np.empty(0, np.int32) for _ in texts]
            if places.new:
                table = np.concatenate([table, model.emissions(places.new)])
                places.new = []
            lengths = np.array([len(own) for own in found])
            langs, scores, runs = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            with_words = np.flatnonzero(lengths)
            if len(with_words):
                ids = np.concatenate([found[i] for i in with_words])
                starts = np.concatenate([[0], np.cumsum(lengths[with_words])[:-1]])
                first = np.zeros(len(ids), bool)
                first[starts] = True
                probable = label_probabilities(model, table[ids], first)
                means = np.add.reduceat(probable, starts, axis=0) / lengths[with_words][:, None]
                best = means.argmax(axis=1)
                for i, label, mean in zip(with_words, best, means):
                    langs[i] = model.languages[label]
                    scores[i] = min(1.0, float(mean[label]))
                if spans:
                    labels = probable.argmax(axis=1)
                    for i, start in zip(with_words, starts):
                        runs[i] = _runs(texts[i], labels[start : start + lengths[i]], model.languages)
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores)]
            names = [*batch.schema.names, "found_lang", "found_score"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                arrays.append(pa.array(runs, kind))
                names.append("found_spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    labelled = plain.mapInArrow(run, f"{fields}, found_lang string, found_score double{extra}")
    return labelled.toDF(*docs.columns, "__lang", "__score", *(["__spans"] if spans else []))


def _runs(text: str, labels: np.ndarray, languages: list[str]) -> list[dict]:
    found: list[dict] = []
    # Lower-casing may change lengths, so places come from the text itself.
    for match, label in zip((m for m in _WORD.finditer(text) if has_letter(m.group())), labels):
        if found and found[-1]["lang"] == languages[label]:
            found[-1]["end"] = match.end()
        else:
            found.append({"start": match.start(), "end": match.end(), "lang": languages[label]})
    return found
