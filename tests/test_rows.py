"""Empty rows and columns, repeated keys, stacking: small frames, skew, and many partitions."""

import pytest
from pyspark.sql import functions as F

from rollbook.operators import dupes, hygiene, stack


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a tenth without a key, the rest in pairs and singles."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, None)
        .when(F.col("id") % 7 == 0, F.concat(F.lit("single"), "id"))
        .otherwise(F.concat(F.lit("pair"), F.floor(F.col("id") / 4)))
    )
    df = spark.range(3000).withColumn("k", key).withColumn("payload", F.col("id") * 2)
    return df.repartition(7, F.rand(1)).cache()


def brute(df):
    groups = {}
    for row in sorted(df.collect(), key=lambda r: r["id"]):
        groups.setdefault(row["k"], []).append(tuple(row))
    return groups


def rows(df):
    assert df.columns == ["id", "k", "payload"]
    return sorted(tuple(r) for r in df.collect())


def by_id(found):
    return sorted(found, key=lambda r: r[0])


def test_first_and_later_rows(skewed):
    groups = brute(skewed)
    first = dupes.first_rows(skewed, ["k"], ["id"])
    later = dupes.later_rows(skewed, ["k"], ["id"])
    assert rows(first) == by_id([g[0] for g in groups.values()])
    assert rows(later) == by_id([r for g in groups.values() for r in g[1:]])


def test_first_row_by_two_order_columns(spark):
    df = spark.createDataFrame(
        [("a", 2, 1), ("a", 1, 9), ("a", 1, 3), (None, 1, 1), (None, 1, 2)], "k string, s int, r int"
    )
    got = {(r.k, r.s, r.r) for r in dupes.first_rows(df, ["k"], ["s", "r"]).collect()}
    assert got == {("a", 1, 3), (None, 1, 1)}


@pytest.mark.parametrize("salts", [dupes.SALTS, 1])
def test_get_dupes_with_hot_keys(skewed, salts, monkeypatch):
    monkeypatch.setattr(dupes, "SALTS", salts)
    groups = brute(skewed)
    got = dupes.get_dupes(skewed, ["k"], ["id"])
    assert got.columns == ["k", "dupe_count", "id", "payload"]
    want = [(k, len(g), r[0], r[2]) for k, g in groups.items() if len(g) > 1 for r in g]
    want.sort(key=lambda r: (-r[1], r[0] is not None, r[0] or "", r[2]))
    assert [tuple(r) for r in got.collect()] == want


@pytest.mark.parametrize("rows,salts", [(20, 2), (100, 16), (1, 1)])
def test_large_keys_get_salts_by_their_size(skewed, rows, salts, monkeypatch):
    monkeypatch.setattr(dupes, "ROWS_A_SALT", rows)
    monkeypatch.setattr(dupes, "SALTS", salts)
    groups = brute(skewed)
    got = dupes.get_dupes(skewed, ["k"], ["id"]).collect()
    want = [(k, len(g), r[0], r[2]) for k, g in groups.items() if len(g) > 1 for r in g]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hot_keys_are_split_when_nothing_can_be_broadcast_at_run_time(skewed, spark):
    """The cold side forced through the shuffle join gives the same rows."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        got = dupes.get_dupes(skewed, ["k"], ["id"])
        n = sum(len(g) for g in brute(skewed).values() if len(g) > 1)
        assert got.count() == n
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_hot_key_rows_spread_over_partitions(skewed, spark):
    """No output partition of the sorted result holds the hot key alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = dupes.get_dupes(skewed, ["k"], ["id"])
        per_task = got.filter(F.col("k") == "hot").groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_first_row_is_one_row(spark):
    """Rows that tie give one first row; a missing order value comes first."""
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 1, "w"), ("a", 2, "v"), ("b", None, "y"), ("b", 3, "z"), (None, None, None)],
        "`k.1` string, o int, v string",
    )
    first = dupes.first_rows(df, ["k.1"], ["o"])
    assert first.columns == df.columns
    assert {tuple(r) for r in first.collect()} == {("a", 1, "w"), ("b", None, "y"), (None, None, None)}
    later = dupes.later_rows(df.filter("v is null or v <> 'x'"), ["k.1"], ["o"])
    assert sorted(tuple(r) for r in later.collect()) == [("a", 2, "v"), ("b", 3, "z")]
    with pytest.raises(Exception, match="do not tell"):
        dupes.later_rows(df, ["k.1"], ["o"]).collect()
    found = dupes.get_dupes(df, ["k.1"], ["o", "v"])
    assert [r["dupe_count"] for r in found.collect()] == [3, 3, 3, 2, 2]


def test_composite_key(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, "a")], "id int, n string, k string"
    )
    assert [r.id for r in dupes.later_rows(df, ["n", "k"], ["id"]).collect()] == [2]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "a", None), (2, None, None, None), (3, None, "", None)],
        "id int, `x y` string, b string, c int",
    )
    kept = hygiene.drop_empty_rows(df, lineage=["id"])
    assert [r.id for r in kept.collect()] == [1, 3]
    assert hygiene.drop_empty_columns(df).columns == ["id", "b"]
    assert hygiene.empty_columns([df, df.select("c"), df.select("b")]) == [["x y", "c"], ["c"], []]


def test_stack_needs_the_same_names(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert sorted(tuple(r) for r in stack.stack([a, b]).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="frame 1 differs"):
        stack.stack([a, b.drop("s")])
    bound = stack.bind_rows([a, b.drop("s")]).collect()
    assert sorted((r.i, r.s) for r in bound) == [(1, "x"), (2, None)]
