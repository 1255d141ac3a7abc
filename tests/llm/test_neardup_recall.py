"""Recall of near duplicates just above the threshold, against the similarity of every planted pair by plain dynamic programming."""

import random

import pytest

from sidewise.llm import neardup


def similarity(a: str, b: str) -> float:
    one, two = (list(zip(*[t.lower().split()[i:] for i in range(5)])) for t in (a, b))
    before = [0] * (len(two) + 1)
    for x in one:
        row = [0]
        for j, y in enumerate(two):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return before[-1] / (len(one) + len(two) - before[-1])


def edited(generator: random.Random, words: list[str]) -> list[str]:
    """Words replaced or inserted in the middle, or lost or added at an end."""
    out = list(words)
    n = len(words)
    kind = generator.randrange(4)
    if kind == 0:
        return out[: n - max(1, round(0.17 * n))]
    if kind == 1:
        return out + [f"more{generator.randrange(10**9)}" for _ in range(max(1, round(0.21 * n)))]
    for _ in range(max(1, round(0.019 * n))):
        place = generator.randrange(5, n - 5)
        out[place : place + (kind == 2)] = [f"other{generator.randrange(10**9)}"]
    return out


@pytest.mark.parametrize("common", [0, 6])
def test_recall_just_above_the_threshold(spark, common):
    """Pairs of similarity 0.80 to 0.85 among texts of 20 to 200 words; ``common`` words open every text."""
    generator = random.Random(31 + common)
    opening = [f"opening{i}" for i in range(common)]
    texts, pairs = [], []
    while len(pairs) < 400:
        words = opening + [f"w{generator.randrange(4000)}" for _ in range(generator.randrange(20, 200))]
        one, two = " ".join(words), " ".join(edited(generator, words))
        if 0.8 <= similarity(one, two) <= 0.85:
            pairs.append((len(texts), len(texts) + 1))
            texts += [one, two]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert len(rows) == len(texts)
    found = sum(rows[a]["class_id"] == rows[b]["class_id"] for a, b in pairs)
    print(f"recall at 0.80 to 0.85, {common} common words: {found} of {len(pairs)}")
    assert found >= 0.99 * len(pairs)
    # Texts of different pairs are not similar, so no class has more than its two.
    assert max(r["class_size"] for r in rows.values()) == 2
