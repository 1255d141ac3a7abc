import pytest

from sidewise.errors import ComparisonError, DuplicateKeyError
from sidewise.operators import valuediff as V

PEOPLE = "customer_id long, name string, age long"
THREE = [(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)]


def frame(spark, rows, schema=PEOPLE):
    return spark.createDataFrame(rows, schema)


def summary(df):
    rows = df.collect()
    totals = {(r["total"], r["added"], r["removed"]) for r in rows}
    assert len(totals) == 1
    return totals.pop(), {r["column"]: (r["matched"], r["matched_p"]) for r in rows}


def detail(base, current, pk, **options):
    return [tuple(r) for r in V.value_diff_detail(base, current, pk, **options).collect()]


def test_one_change(spark):
    base, current = frame(spark, [(1, "Alice", 35), *THREE[1:]]), frame(spark, THREE)
    totals, columns = summary(V.value_diff(base, current, "customer_id"))
    assert totals == (3, 0, 0)
    assert columns["age"] == (2, pytest.approx(2 / 3)) and columns["name"] == columns["customer_id"] == (3, 1.0)
    assert detail(base, current, "customer_id") == [(1, "Alice", 35, True, False), (1, "Alice", 30, False, True)]


def test_identical(spark):
    df = frame(spark, THREE)
    totals, columns = summary(V.value_diff(df, df, "customer_id"))
    assert totals == (3, 0, 0) and set(columns.values()) == {(3, 1.0)}
    assert detail(df, df, "customer_id") == []


def test_added_and_removed(spark):
    two, three = frame(spark, THREE[:2]), frame(spark, THREE)
    assert summary(V.value_diff(two, three, "customer_id"))[0] == (3, 1, 0)
    assert summary(V.value_diff(three, two, "customer_id"))[0] == (3, 0, 1)
    assert detail(two, three, "customer_id") == [(3, "Charlie", 35, False, True)]


def test_nothing_in_common(spark):
    _, columns = summary(V.value_diff(frame(spark, THREE[:1]), frame(spark, THREE[1:]), "customer_id"))
    assert columns["age"] == (0, None)


def test_composite_key(spark):
    schema = "region string, customer_id long, name string, revenue long"
    base = frame(spark, [("US", 1, "Alice", 100), ("US", 2, "Bob", 200), ("EU", 1, "Charlie", 150)], schema)
    current = frame(spark, [("US", 1, "Alice", 100), ("US", 2, "Bob", 250), ("EU", 1, "Charlie", 150)], schema)
    totals, columns = summary(V.value_diff(base, current, ["region", "customer_id"]))
    assert totals == (3, 0, 0) and columns["revenue"][0] == 2
    assert len(detail(base, current, ["region", "customer_id"])) == 2


def test_column_subset_and_case(spark):
    schema = "customer_id long, name string, age long, city string"
    base = frame(spark, [(1, "Alice", 30, "NYC"), (2, "Bob", 25, "LA")], schema)
    current = frame(spark, [(1, "Alice", 31, "NYC"), (2, "Bob", 25, "SF")], schema)
    assert list(summary(V.value_diff(base, current, "CUSTOMER_ID", columns=["Name"]))[1]) == ["customer_id", "name"]
    assert summary(V.value_diff(base, current, "customer_id", columns=['"age"']))[1]["age"][1] == 0.5


def test_nulls(spark):
    base = frame(spark, [(1, "Alice", 30), (2, None, 25), (3, "Charlie", None)])
    current = frame(spark, [(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)])
    totals, columns = summary(V.value_diff(base, current, "customer_id"))
    assert totals == (3, 0, 0) and columns["name"][0] == columns["age"][0] == 2
    statuses = {(r["column"], r["match_status"]): r["count_records"] for r in V.value_diff_status(base, current, "customer_id").collect()}
    assert statuses[("name", V.NULL_BASE)] == 1 and statuses[("age", V.NULL_BASE)] == 1
    assert (V.MISMATCH not in {status for _, status in statuses})


@pytest.mark.parametrize(
    "schema, base, current, pk",
    [
        ("id long, column_name string, value long", [(1, "foo", 100), (2, "bar", 200)], [(1, "foo", 100), (2, "bar", 300)], "id"),
        ("`47_1_TransId` long, name string, age long", [(1, "Alice", 30), (2, "Bob", 25)], [(1, "Alice", 31), (2, "Bob", 25)], "47_1_TransId"),
        ("`47_1_TransId` long, `2nd_key` string, value long", [(1, "A", 100), (2, "B", 200)], [(1, "A", 100), (2, "B", 250)], ["47_1_TransId", "2nd_key"]),
    ],
)
def test_awkward_names(spark, schema, base, current, pk):
    base, current = frame(spark, base, schema), frame(spark, current, schema)
    totals, columns = summary(V.value_diff(base, current, pk))
    assert totals == (2, 0, 0) and sum(m == 1 for m, _ in columns.values()) == 1
    assert len(detail(base, current, pk)) == 2


def test_duplicate_keys_are_refused(spark):
    twice = frame(spark, [*THREE, (3, "Other", 1)])
    with pytest.raises(DuplicateKeyError):
        V.value_diff(frame(spark, THREE), twice, "customer_id")
    verdict = {r["side"]: (r["duplicate_keys"], r["is_valid"]) for r in V.verify_primary_key(frame(spark, THREE), twice, "customer_id").collect()}
    assert verdict == {"base": (0, True), "current": (1, False)}
    with pytest.raises(ComparisonError):
        V.value_diff(twice, twice, [])


def joined_by_hand(base, current, keys):
    """All pairs that a full outer join on null-safe keys would form."""
    used, pairs = set(), []
    for b in base:
        partners = [i for i, c in enumerate(current) if [c[k] for k in keys] == [b[k] for k in keys]]
        used.update(partners)
        pairs += [(b, current[i]) for i in partners] or [(b, None)]
    return pairs + [(None, c) for i, c in enumerate(current) if i not in used]


def test_null_keys_count_as_pairs(spark):
    base = [(None, "x", 1), (None, "x", None), (None, None, 1), (1, "a", 1), (2, "b", 2)]
    current = [(None, "x", 1), (None, None, None), (1, "a", 5), (3, "c", 3)]
    pairs = joined_by_hand(base, current, [0])
    both = [(b, c) for b, c in pairs if b and c]
    totals, columns = summary(V.value_diff(frame(spark, base), frame(spark, current), "customer_id"))
    assert totals == (len(pairs), sum(b is None for b, _ in pairs), sum(c is None for _, c in pairs))
    for i, name in enumerate(("customer_id", "name", "age")):
        assert columns[name][0] == sum(b[i] == c[i] for b, c in both)
    statuses = {(r["column"], r["match_status"]): r["count_records"] for r in V.value_diff_status(frame(spark, base), frame(spark, current), "customer_id").collect()}
    for i, name in enumerate(("customer_id", "name", "age")):
        assert statuses.get((name, V.BOTH_NULL), 0) == sum(b[i] is None and c[i] is None for b, c in both)
        assert statuses.get((name, V.NULL_BASE), 0) == sum(b[i] is None and c[i] is not None for b, c in both)
        assert statuses.get((name, V.MISMATCH), 0) == sum(None not in (b[i], c[i]) and b[i] != c[i] for b, c in both)


def test_null_keys_on_one_side_only(spark):
    base = frame(spark, [(None, "x", 1), (None, "y", 1), (1, "a", 1)])
    current = frame(spark, [(1, "a", 1)])
    assert summary(V.value_diff(base, current, "customer_id"))[0] == (3, 0, 2)


def test_impact_of_repeated_keys(spark):
    base = [(1, "a", 10), (1, "a", 20), (1, "b", 10), (2, "c", 5), (4, "e", None), (4, "e", None)]
    current = [(1, "a", 10), (1, "a", 10), (2, "c", 6), (3, "d", 7), (3, "d", 7), (4, "e", None)]
    pairs = joined_by_hand(base, current, [0])
    both = [(b, c) for b, c in pairs if b and c]
    rows = {r["column"]: r for r in V.impact_value_diff(frame(spark, base), frame(spark, current), "customer_id").collect()}
    for i, name in ((1, "name"), (2, "age")):
        assert rows[name]["changed"] == sum(b[i] != c[i] for b, c in both)
        assert rows[name]["rows_added"] == sum(b is None for b, _ in pairs)
        assert rows[name]["rows_removed"] == sum(c is None for _, c in pairs)
        assert rows[name]["rows_changed"] == sum(b[1:] != c[1:] for b, c in both)
    ages = [b[2] for b, _ in pairs if b and b[2] is not None]
    assert rows["age"]["base_mean"] == pytest.approx(sum(ages) / len(ages))


def test_side_swap_and_totals(spark):
    base, current = frame(spark, [*THREE, (9, "Z", 1)]), frame(spark, [(1, "Alice", 1), (2, None, 25), (4, "D", 4)])
    (total, added, removed), _ = summary(V.value_diff(base, current, "customer_id"))
    assert summary(V.value_diff(current, base, "customer_id"))[0] == (total, removed, added)
    per_column = {}
    for r in V.value_diff_status(base, current, "customer_id").collect():
        per_column[r["column"]] = per_column.get(r["column"], 0) + r["count_records"]
    assert set(per_column.values()) == {total}


def test_multiset_and_maps(spark):
    schema = "id long, tags map<string,int>"
    base = frame(spark, [(1, {"a": 1, "b": 2}), (1, {"a": 1, "b": 2}), (2, {"x": 1})], schema)
    current = frame(spark, [(1, {"b": 2, "a": 1}), (2, {"x": 2})], schema)
    distinct = V.one_sided_rows(base, current, ["id", "tags"])
    assert sorted((r["id"], r["in_a"]) for r in distinct.collect()) == [(2, False), (2, True)]
    copies = V.one_sided_rows(base, current, ["id", "tags"], multiset=True)
    assert sorted((r["id"], r["in_a"]) for r in copies.collect()) == [(1, True), (2, False), (2, True)]


def test_a_hot_key_is_refused_before_any_pair_forms(spark):
    from sidewise.errors import DuplicateKeyError
    from sidewise.operators import rowdiff

    rows = [(i if i % 3 else 0, "n", i) for i in range(30_000)]
    base = current = frame(spark, rows)
    for compare in (V.value_diff, V.value_diff_status, rowdiff.row_diff, rowdiff.cell_diff):
        with pytest.raises(DuplicateKeyError):
            compare(base, current, "customer_id")
    # Grouping needs no unique key: a third of the rows share one.
    assert V.value_diff_detail(base, current, "customer_id", multiset=True, check_key=False).count() == 0
