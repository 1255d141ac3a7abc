"""Token files, packing and word-based encoding against the tokenizers library and small brute force."""

import itertools
import json
import zlib
from array import array
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sidewise.llm import packing, tokenfiles, wordbpe
from sidewise.llm.encoding import Encoder
from sidewise.llm.queries import vocabulary
from sidewise.plans.storage import shared_path

BYTE_LEVEL, WORD_LEVEL = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b ", "a <|endoftext|> b", "it's I'M we'll\n\n x\t y", "日本語 テキスト", "é é x\xa0y", "a\x1cb c", "x \n",
    "½ ² 12a_b--c 'S 's", "the same row", "the same row", "word, " * 4000, "x" * 5000, "ΣΑΣ İI\x85c <|startoftext|> hi",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_LEVEL)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with ours."""
    rows = [(i if i else None, text, "p", i, "r") for i, text in enumerate(ODD)] + [(11, ODD[11], "q", 0, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, rank int, part string")


def expected(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé'.,1\n\t\xa0Σ日½_-"), max_size=40))
def test_encoder_equals_library(text):
    encoder = test_encoder_equals_library.encoder
    assert array("I", encoder.ids(text)).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


test_encoder_equals_library.encoder = Encoder(BYTE_LEVEL)


def test_token_files(spark, library, docs):
    folder = shared_path(spark, "test")
    tokenfiles.write_token_files(docs, folder, BYTE_LEVEL, end_id=0)
    got = sorted(map(tuple, tokenfiles.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    keys = [key for key, *_ in got]
    assert keys == [None, *sorted(key for key in keys if key is not None)]
    assert [start for _, start, *_ in got] == [0, *itertools.accumulate(n for *_, n, _ in got)][:-1]
    ids = [expected(library, text, 0) for text in [*ODD, ODD[11]]]
    crcs = Counter((len(own), zlib.crc32(array("I", own).tobytes())) for own in ids)
    assert Counter((n, crc) for *_, n, crc in got) == crcs


def test_token_files_of_nothing(spark, docs):
    folder = shared_path(spark, "test")
    tokenfiles.write_token_files(docs.limit(0), folder, BYTE_LEVEL, end_id=0)
    assert tokenfiles.read_token_files(spark, folder).collect() == []


@pytest.mark.parametrize("end_id, width", [(0, "<u2"), (70_000, "<u4")])
def test_ids_are_as_wide_as_needed(spark, docs, end_id, width):
    folder = shared_path(spark, "test")
    tokenfiles.write_token_files(docs.limit(3), folder, BYTE_LEVEL, end_id=end_id)
    with open(f"{folder.removeprefix('file:')}/dataset.json") as file:
        dataset = json.load(file)
    assert dataset["ids"] == width
    part = tokenfiles.TokenPart(folder, dataset["parts"][0]["name"], width)
    assert part[0][-1] == end_id


def fewest(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(sizes):
    left = Counter(sizes)
    fixed = packing._reduce(left, 20)
    used = Counter()
    for content, bins in fixed:
        assert sum(size * n for size, n in content) <= 20
        used.update({size: n * bins for size, n in content})
    assert used + left == Counter(sizes)
    assert sum(bins for _, bins in fixed) + fewest(sorted(left.elements(), reverse=True), 20) == fewest(sorted(sizes, reverse=True), 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan_holds_everything(counts):
    used, bins = Counter(), 0
    patterns = packing.plan(counts, 64)
    for content, n in patterns:
        assert n > 0 and sum(size * each for size, each in content) <= 64
        used.update({size: each * n for size, each in content})
        bins += n
    assert used == Counter(counts)
    total = sum(size * n for size, n in counts.items())
    assert bins <= max(1, 2 * total / 64) or not counts
    assert len(patterns) <= 6 * len(counts)


@pytest.mark.parametrize("keep", [False, True])
def test_pack(spark, library, docs, keep):
    rows = packing.pack(docs, BYTE_LEVEL, end_id=2, capacity=64, keep_ids=keep).collect()
    whole = Counter(tuple(expected(library, text, 2)) for text in [*ODD, ODD[11]])
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(row["length"] for row in rows) == sum(len(ids) * n for ids, n in whole.items())
    assert all(row["length"] == 64 for row in rows if row["piece"] > 0)
    for row in rows:
        if keep:
            assert len(row["ids"]) == row["length"]
            assert zlib.crc32(array("I", row["ids"]).tobytes()) == row["ids_crc32"]
    whole_crcs = {zlib.crc32(array("I", ids).tobytes()) for ids in whole if len(ids) <= 64}
    assert whole_crcs <= {row["ids_crc32"] for row in rows}


def test_pack_nothing(spark, docs):
    assert packing.pack(docs.limit(0), BYTE_LEVEL, end_id=2).collect() == []


def test_word_encoding(spark, docs):
    library = Tokenizer.from_file(WORD_LEVEL)
    got = Counter((r["ids"], r["decoded"]) for r in wordbpe.encode(docs, WORD_LEVEL).collect())
    want = Counter()
    for text in [*ODD, ODD[11]]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    digests = wordbpe.encode_decode(docs.filter("doc_id = 9"), WORD_LEVEL).first()
    ids = library.encode(ODD[9], add_special_tokens=False).ids
    assert digests["n_tokens"] == len(ids)
    assert digests["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert wordbpe.encode(docs.limit(0), WORD_LEVEL).collect() == []


def test_word_encoding_over_many_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(wordbpe, "BLOCK_BYTES", 200)
    library = Tokenizer.from_file(WORD_LEVEL)
    rows = [(i, f"alpha beta{i % 7} gamma{i}, the the") for i in range(300)]
    got = {r["id"]: r["decoded"] for r in wordbpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), WORD_LEVEL).collect()}
    assert got == {i: library.decode(library.encode(text).ids, skip_special_tokens=False) for i, text in rows}
