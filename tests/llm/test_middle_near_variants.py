"""Fill-in-the-middle, approximate neighbours and spelling variants against brute force, by operator and by query."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sidewise.llm import ann, fim, variants

FOLDER = "/root/testdata/sf0.001"


def example(key, text, seed=7, unit="line", percent=100):
    """One text cut the plain way."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.Sentinels()) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    generator = random.Random(5)
    made = [None, "", "\n", "\n\n", "a", "a\n", "no end", "ß\nß", "<S>", "a<P\n>b", "<", "\U0001f600\nmixed é\n\nend", "x" * 70000 + "\n" + "é" * 70000]
    for _ in range(300):
        made.append("".join(generator.choice(["a", "é", "\n", "\n", "\U0001f600", "word ", "<", "<M"]) for _ in range(generator.randrange(60))))
    return made


@pytest.mark.parametrize("unit", ["line", "character"])
@pytest.mark.parametrize("batch_bytes", [64, 8 << 20])
def test_fill_in_middle(spark, monkeypatch, unit, batch_bytes):
    monkeypatch.setattr(fim, "BATCH_BYTES", batch_bytes)
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "with\nno\nid", "x"), (3, "\n\n", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(5)
    made = fim.fill_in_middle(docs, unit=unit, percent=80)
    found = made.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    ours = sorted(((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=str)
    assert ours == sorted(((key, *example(key, text, unit=unit, percent=80)) for key, text, _ in rows), key=str)
    assert Counter(r["back"] for r in found) == Counter(text or "" for _, text, _ in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_bad_sentinels(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S<", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.check_sentinels(fim.Sentinels(*bad))


def test_rank_and_select():
    generator = np.random.default_rng(1)
    data = generator.choice(np.array([10, 65, 195, 169], np.uint8), 999)
    marks = fim.line_ends(fim.as_words(data))
    places = np.flatnonzero(data == 10)
    assert (marks.select(np.arange(1, len(places) + 1)) == places).all()
    assert (marks.rank(np.arange(1000)) == np.concatenate([[0], np.cumsum(data == 10)])).all()


def test_fill_in_middle_query(spark):
    found = entry.queries()["op11_fill_in_middle"](spark, FOLDER)
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string",
    }
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for key, text in docs:
        *facts, output = example(key, text)
        expected.add((key, *facts, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in found.collect()} == expected


def neighbours(vectors, is_query, k):
    """The nearest other rows of each query, by brute force."""
    ids = np.array(sorted(vectors))
    rows = np.array([vectors[i] for i in ids], np.float64)
    found = {}
    for q in ids[[is_query(i) for i in ids]].tolist():
        away = np.sqrt(((rows - np.asarray(vectors[q], np.float64)) ** 2).sum(axis=1))
        found[q] = [(int(ids[i]), float(away[i])) for i in np.lexsort((ids, away)) if ids[i] != q][:k]
    return found


def check_neighbours(rows, vectors, is_query, k):
    """Ranks, exact scores and order of an answer; returns its recall."""
    expected = neighbours(vectors, is_query, k)
    found = defaultdict(list)
    for r in rows:
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {q for q, own in expected.items() if own}
    hits = total = 0
    for q, own in found.items():
        own.sort()
        assert [rank for rank, _, _ in own] == list(range(1, len(expected[q]) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own) and q not in {v for _, v, _ in own}
        for _, v, score in own:
            assert score == pytest.approx(np.sqrt(((np.float64(vectors[v]) - np.float64(vectors[q])) ** 2).sum()), abs=1e-12)
        hits += len({v for _, v, _ in own} & {v for v, _ in expected[q]})
        total += len(expected[q])
    return hits / total if total else 1.0


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "ASK_ROWS", 4)
    generator = np.random.default_rng(4)
    centres = generator.normal(size=(12, 8)) * 4
    # float32 throughout, so that sums start from the same values.
    vectors = {i: (centres[i % 12] + generator.normal(size=8)).astype(np.float32).tolist() for i in range(1500)}
    vectors |= {i: vectors[0] for i in range(1500, 2100)}  # one vector with very many rows
    vectors |= {2100: vectors[7], 2110: vectors[7]}
    rows = [(i, v, "x") for i, v in vectors.items()]
    junk = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 7]
    rows += [(5000 + 10 * i, v, "x") for i, v in enumerate(junk)] + [(None, vectors[1], "x"), rows[10], rows[10]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string").repartition(6)
    index = ann.build(table, 5)
    assert len(index.graph.centroids) > 30
    found = ann.search(index, F.col("id") % 10 == 0, 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert check_neighbours(found.collect(), vectors, lambda i: i % 10 == 0, 5) >= 0.9
    # Every distinct vector has one home, and boundary vectors are in further lists.
    distinct = len({tuple(v) for v in vectors.values()})
    assert index.homes.sum() == distinct < index.postings.count()
    # A ratio that visits all lists finds everything.
    everything = ann.search(index, F.col("id") % 10 == 0, 5, ratio=1e9)
    assert check_neighbours(everything.collect(), vectors, lambda i: i % 10 == 0, 5) == 1.0


@pytest.mark.parametrize("count", [0, 1, 2, 4])
def test_few_vectors(spark, count):
    vectors = {i: [1.0, float(i)] for i in range(count)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert check_neighbours(ann.nearest_neighbours(table, F.col("id") >= 0, 10).collect(), vectors, lambda i: True, 10) == 1.0


def test_centroid_graph():
    generator = np.random.default_rng(2)
    centroids = generator.normal(size=(400, 6))
    graph = ann.CentroidGraph(centroids)
    hits = total = 0
    for query in generator.normal(size=(50, 6)):
        away = np.sqrt(((centroids - query) ** 2).sum(axis=1))
        expected = set(np.flatnonzero(away <= 1.3 * away.min()).tolist())
        found, distances = graph.within(query, 1.3)
        assert (np.diff(distances) >= 0).all() and np.allclose(distances, away[found])
        hits, total = hits + len(expected & set(found.tolist())), total + len(expected)
    assert hits / total > 0.97


def test_balanced_centroids():
    generator = np.random.default_rng(3)
    sample = np.concatenate([generator.normal(size=(900, 4)), generator.normal(size=(100, 4)) + 20])
    centroids = ann.balanced_centroids(sample, 20)
    sizes = np.bincount(ann.squared_distances(sample, centroids).argmin(axis=1), minlength=20)
    assert sizes.max() <= 3 * sizes.mean()


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_nearest_neighbours_query(spark, folder):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found = entry.queries()["op12_nearest_neighbours"](spark, folder)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert check_neighbours(found.collect(), vectors, lambda i: i % 100 == 0, 10) >= 0.9


def plain_words(docs, every=31):
    """The word table the plain way: every run of letters, A to Z lower-cased one by one."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            drawn = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and drawn % every == 0:
                run = run[: drawn % len(run)] + run[drawn % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    by_length = defaultdict(list)
    for word in counts:
        by_length[len(word)].append(word)
    near = {w: [o for n in (-1, 0, 1) for o in by_length[len(w) + n] if is_near(w, o)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= ratio * counts[word]:
            form[word] = best
    rows = set()
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None))
    return rows


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256])
def test_spelling_variants(spark, monkeypatch, filter_bytes):
    # The small bound makes many probing passes; small filters make many false positives.
    monkeypatch.setattr(variants, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(variants, "RANGE_BLOCKS", 2)
    monkeypatch.setattr(variants, "PROBES", 300)
    if filter_bytes == 256:
        monkeypatch.setattr(variants, "BITS_PER_KEY", 4)
    generator = random.Random(8)
    made = ["".join(generator.choice("abé") for _ in range(generator.randrange(1, 8))) for _ in range(500)]
    counts = Counter({word: generator.choice([1, 3, 30, 400, 5000]) for word in made})
    counts |= {"a" * 70: 2, "a" * 71: 50, "a" * 3000: 3, "a" * 2999 + "b": 40}
    rows = [(word, n, None) for word, n in counts.items()] + [("abab", 5, "x"), (None, 7, "x"), ("", 9, "x"), ("none", None, "x"), ("zero", 0, "x")]
    counts["abab"] += 5
    table = spark.createDataFrame(rows, "word string, n long, near string").repartition(4)
    found = variants.spelling_variants(table)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == plain_variants(counts)


def test_chain_of_forms(spark):
    counts = {"abcdefgh"[:i]: 10 ** (8 - i) for i in range(1, 9)}
    found = variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in found} == plain_variants(counts) and {r["root"] for r in found} == {"a"}
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_corpus_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 40)
    monkeypatch.setattr(variants, "HELD_WORDS", 10)
    generator = random.Random(6)
    words = ["".join(generator.choice("abcÀÿ×AÉ") for _ in range(generator.randrange(5, 12))) for _ in range(40)]
    docs = [(i, " 1,\n"[generator.randrange(4)].join(generator.choices(words, k=60))) for i in range(80)]
    docs += [(None, "keepsake keepsake Keepsake"), (7, None), (8, ""), (9, "q" * 500), (9, "q" * 500)]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)
    for every in (31, 3, None):
        found = variants.corpus_words(table, typo_every=every).collect()
        assert {r["word"]: r["n"] for r in found} == plain_words(docs, every)
    assert variants.corpus_words(table.limit(0)).collect() == []


def test_spelling_variants_query(spark):
    found = entry.queries()["op13_spelling_variants"](spark, FOLDER)
    assert found.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")
    ]
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in found.collect()} == plain_variants(plain_words(docs))
