"""Web archives and vector search against brute force, and the pipeline on a small corpus."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sidewise.llm import languageid, vectors, warc
from sidewise.plans.storage import shared_path


def pages_of(n):
    generator = random.Random(1)
    rows = []
    for i in range(n):
        body = generator.choice([None, "", "short", "same payload " * 100, "other payload é " * 90, f"page {i} " * 200])
        rows.append((i, generator.choice([None, "http://Example.org:8080/a b?x=1", f"https://www.host{i % 3}.net/p/{i}", "http://[bad"]), body, "d"))
    return [*rows, (None, "http://x.y/", "same payload " * 100, "d"), rows[0]]


@pytest.mark.parametrize("fan_in", [32, 2])
def test_archives(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "STREAM_ROWS", 4)
    rows = pages_of(150)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(7)
    folder = shared_path(spark, "test")
    captures = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()
    assert len(captures) == len(rows)
    ordered = sorted(captures, key=lambda c: (c["range"], c["place"]))
    keys = [warc._key(c.asDict()) for c in ordered]
    assert keys == sorted(keys)
    largest = {}
    for key, _, body, _ in rows:
        if len((body or "").encode()) >= 1000:
            largest[body] = max(largest.get(body, -1), -1 if key is None else key)
    by_id = {key: body or "" for key, _, body, _ in rows}
    responses = {}
    for c in captures:
        body = by_id[c["page_id"]]
        assert c["payload_bytes"] == len(body.encode())
        if body in largest:
            if c["record_type"] == "response":
                assert body not in responses
                responses[body] = c["page_id"]
            else:
                assert c["refers_to"] == largest[body]
        else:
            assert c["record_type"] == "response" and c["refers_to"] is None
    assert responses == largest
    system, path = warc.open_folder(folder)
    c = next(c for c in captures if c["record_type"] == "response" and c["page_id"] and c["payload_bytes"] > 1000)
    with system.open_input_file(f"{path}/{c['archive']}") as file:
        file.seek(c["offset"])
        header, http, payload = warc.parse(next(warc.records(pa.BufferReader(file.read(c["length"]))))[2])
    assert payload.decode() == by_id[c["page_id"]] and header["warc-type"] == "response"


def test_plans_of_many_files():
    """Plans name the files that may hold keys of their range, and planning walks each run once."""
    generator = random.Random(7)
    runs = []
    for r in range(3):
        keys = sorted((f"k{generator.randrange(400):03d}", "t", True, i, i) for i in range(900))
        runs.append([{"name": f"{r}-{i}", "rows": 30, "keys": json.dumps(keys[i : i + 30 : 10])} for i in range(0, 900, 30)])
    plans = [json.loads(plan) for plan in warc._plans(runs)]
    assert plans[0]["low"] is None and plans[-1]["high"] is None
    assert [p["high"] for p in plans[:-1]] == [p["low"] for p in plans[1:]]
    for plan in plans:
        named = {name for names in plan["runs"] for name in names}
        for run in runs:
            for i, file in enumerate(run):
                first = json.loads(file["keys"])[0]
                last = json.loads(run[i + 1]["keys"])[0] if i + 1 < len(run) else None
                below = plan["high"] is None or first < plan["high"]
                above = plan["low"] is None or last is None or last > plan["low"]
                assert (file["name"] in named) == (below and above)


def test_times_beyond_dates(spark):
    rows = [(1, "http://a.b/", "x", 10**15), (2, "http://a.b/", "y", -(10**15)), (3, "http://a.b/", "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen long")
    folder = shared_path(spark, "test")
    captures = warc.read_archives(spark, folder, warc.write_archives(pages, folder, time_column="seen")).collect()
    assert {c["page_id"]: c["timestamp"] for c in captures} == {1: "99991231235959", 2: "00010101000000", 3: "19700101000000"}


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_path(spark, "test")
    assert warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect() == []


def test_loser_tree():
    generator = random.Random(3)
    row = lambda i: {"url_key": "k", "timestamp": f"{generator.randrange(50):02d}", "page_id": i, "row": i}
    for n in (0, 1, 2, 3, 7):
        runs = [sorted((row(i) for i in range(generator.randrange(9))), key=warc._key) for _ in range(n)]
        merged = [warc._key(r) for r in warc.LoserTree([iter(run) for run in runs])]
        assert merged == sorted(warc._key(r) for run in runs for r in run)


@pytest.mark.parametrize("block", [4096, 40])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    generator = np.random.default_rng(2)
    points = generator.normal(size=(300, 6)).round(1)
    points[50:150] = points[50]  # a third of all vectors are equal
    rows = [(i, [float(x) for x in p], "n") for i, p in enumerate(points)]
    rows += [(400, None, "n"), (450, [], "n"), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (550, [float("nan")] * 6, "n"), (600, [float("inf")] * 6, "n")]
    rows += [(650, [1.0, 2.0], "n"), (651, [2.0, 1.0], "n"), (None, [0.0] * 6, "n"), rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")
    got = sorted(map(tuple, vectors.top_k(table, F.col("id") % 50 == 0, k=5, scale=256).collect()))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:300]} | {650: np.array([256, 512]), 651: np.array([512, 256])}
    want = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:5], 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("size, block", [(2**25, 4096), (2**30, 40), (2**33, 4096), (2**45, 40)])
def test_top_k_of_large_components(spark, monkeypatch, size, block):
    """Scores beyond doubles, and beyond 64-bit integers, where they are moved to the ends and tie."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    generator = random.Random(size)
    whole = {i: [generator.choice([-1, 1]) * (size + generator.randrange(100)) for _ in range(5)] for i in range(200)}
    # Pairs whose large terms cancel out.
    whole |= {200 + i: [size, -size, generator.randrange(9), size + i, -size] for i in range(20)}
    table = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in whole.items()], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.top_k(table, F.col("id") % 50 == 0, k=5, scale=256).collect()))
    want = []
    for q in (0, 50, 100, 150, 200):
        scores = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        ranked = sorted((-max(-(2**63), min(2**63 - 1, score)), i) for i, score in scores.items())
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(ranked[:5], 1)]
    assert got == want


def test_top_k_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.top_k(table, F.col("id") % 50 == 0, k=5, scale=256).collect() == []


def test_pipeline(spark):
    from corpus_pipeline import STAGES

    generator = random.Random(6)
    lexicon = "the and of that with which there they were this from have been through though".split()
    text = lambda n: " ".join(generator.choice(lexicon) + str(generator.randrange(30)) for _ in range(n))
    base = [text(120) for _ in range(12)]
    near = base[0].split()
    near[40] = "changed"
    texts = [*base, base[1], " ".join(near), "12345 !!", None, base[2] + " write to me@host.org"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert 14 not in rows and 15 not in rows  # no letters
    assert (1 in rows) + (12 in rows) == 1  # an exact copy
    assert (0 in rows) + (13 in rows) == 1  # a near copy
    assert not any("me@host.org" in r["text"] for r in rows.values())
    assert set(range(3, 12)) <= set(rows)
    packed = STAGES[-1][1](spark, kept, "").collect()
    assert {r["doc_id"] for r in packed} == set(rows)


def test_pipeline_keeps_mixed_short_and_unlabelled_documents(spark):
    from corpus_pipeline import identify_language

    lexicons = {
        "en": "the and of that with which there they were this from have been through though".split(),
        "de": "der die und nicht eine schreiben zwischen werden können durch über noch schon wieder".split(),
        "fr": "le les est une dans pour que qui avec cette mais nous vous être leurs toujours".split(),
    }
    generator = random.Random(8)
    text = lambda lang, n: " ".join(generator.choice(lexicons[lang]) for _ in range(n))
    rows = [(None, text(lang, 25), lang) for _ in range(40) for lang in lexicons]
    mixed = [". ".join(text(lang, 30) for lang in order) for order in (("en", "de", "fr"), ("fr", "en", "de"), ("en", "fr"), ("de", "en"))]
    # Words that may be of any language.
    short = ["zq", "ok", "a", "Mmmh", "x1y", "Öäß", "漢字"]
    made = {i: t for i, t in enumerate([*mixed, *short])}
    none = {100 + i: t for i, t in enumerate(["", "12 345 !!", None])}
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in (made | none).items()]], schema)
    kept = identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == len(rows)
    got = {r["doc_id"]: r for r in kept.filter("doc_id is not null").collect()}
    assert {i: r["text"] for i, r in got.items()} == made
    assert all(r["lang"] in lexicons for r in got.values())
    # The case at hand: no language makes up half of such a text.
    model = languageid.learn(docs)
    scores = languageid.identify(docs.filter("doc_id in (0, 1)"), model).select("__score").collect()
    assert all(r["__score"] < 0.5 for r in scores)

    unlabelled = spark.createDataFrame([(i, t, None) for i, t in (made | none).items()], schema)
    assert {tuple(r) for r in identify_language(spark, unlabelled, "").collect()} == {(i, t, None) for i, t in (made | none).items()}
