import numpy as np
from pyspark.sql import functions as F

from syntabula.operators import intervals, loci, pairs, scale
from syntabula.operators.assembly import n50
from syntabula.operators.pairs import chunk_assign
from syntabula.operators.scale import exact_quantiles, first_per_group, with_rank
from syntabula.operators.synteny import every_nth_sample


def skewed(spark, n=20_000):
    """Two thirds of the rows share one key."""
    data = [("hot" if i % 3 else f"k{i % 50}", i * 7919 % 1_000_003, float((i * 37) % 1009)) for i in range(n)]
    return spark.createDataFrame(data, "k string, id long, v double").repartition(5)


def test_rank_of_hot_groups_equals_window(spark):
    df = skewed(spark)
    order = [F.col("v"), F.col("id")]
    sliced, plain = with_rank(df, ["k"], order, "r", group_rows=100), with_rank(df, ["k"], order, "r")
    assert sliced.schema == plain.schema
    assert sliced.exceptAll(plain).count() == 0 and plain.count() == sliced.count()


def test_rank_without_groups(spark):
    df = spark.range(1000).repartition(7)
    got = {r["id"]: r["r"] for r in with_rank(df, [], [F.desc("id")], "r", group_rows=10).collect()}
    assert got == {i: 1000 - i for i in range(1000)}


def test_exact_quantiles_through_brackets(spark):
    df = skewed(spark)
    probs = {"q1": 0.25, "m": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}
    got = exact_quantiles(df, ["k"], "v", probs, accuracy=100).toPandas().set_index("k")
    for k, values in df.toPandas().groupby("k").v:
        assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(values, list(probs.values())), atol=0)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 6, 8, 10)] + [("b", 5)], "k string, v long")
    got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}, "upper").collect()}
    assert got == {"a": 8.0, "b": 5.0}
    assert exact_quantiles(df.filter("k = 'a'"), [], "v", {"m": 0.5}).first()["m"] == 7.0


def test_first_per_group(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 9, "y"), ("a", 2, 99, "z")], "k string, p long, q long, t string")
    assert first_per_group(df, ["k"], [("p", "asc"), ("q", "desc")]).first() == ("a", 1, 9, "y")


def test_n50(spark):
    df = spark.createDataFrame([("a", x) for x in (2, 2, 3, 4, 9)] + [("b", 200_000), ("b", 70_000), ("b", 131_072)], "k string, n long")
    assert {r["k"]: r["n50"] for r in n50(df, ["k"], "n").collect()} == {"a": 4, "b": 131_072}
    assert n50(df.filter("k = 'a'"), [], "n").first()["n50"] == 4


def test_n50_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(f"k{i % 4}", int(x)) for i, x in enumerate(rng.lognormal(10, 2, 800))]
    got = {r["k"]: r["n50"] for r in n50(spark.createDataFrame(data, "k string, n long"), ["k"], "n").collect()}
    for k in got:
        values = sorted((n for g, n in data if g == k), reverse=True)
        upto = np.cumsum(values)
        assert got[k] == values[int(np.argmax(upto * 2 >= upto[-1]))]


def test_every_nth_and_chunks(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "k string, i long")
    kept = every_nth_sample(df, ["k"], [F.col("i")], 4)
    assert sorted(r["i"] for r in kept.filter("k = 'a'").collect()) == [0, 2, 5, 7]
    assert kept.filter("k = 'b'").count() == 1
    chunks = chunk_assign(df, ["k"], [F.col("i")], 4)
    assert {(r["chunk"], r["chunk_start"], r["chunk_end"]) for r in chunks.filter("k = 'a'").collect()} == {
        (1, 1, 4),
        (2, 5, 8),
        (3, 9, 10),
    }


def test_tables_are_released(spark):
    from pathlib import Path

    from syntabula import session

    session.release_tables(spark)
    table = session.cut_lineage(spark.range(10).selectExpr("id", "id % 2 AS k"))
    assert table.count() == 10
    path = Path(session._WRITTEN[-1].removeprefix("file:"))
    assert path.is_dir() and session.release_tables(spark) == 1 and not path.exists()


def test_quantiles_of_a_hot_group_are_dealt_out(spark):
    """The rows of a group meet neither in one partition before the count nor in the result's way."""
    df = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN 'hot' ELSE 'cold' END AS k", "CAST(id AS DOUBLE) AS v")
    found = exact_quantiles(df, ["k"], "v", {"mid": 0.5})
    assert {r["k"]: r["mid"] for r in found.collect()} == {"hot": 9999.5, "cold": 24999.5}
    plan = found._jdf.queryExecution().toString()
    assert "RepartitionByExpression [k" in plan and "_segment" in plan


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Merging, set differences and presence take as many tasks as rows need, not a fixed count."""
    monkeypatch.setattr(scale, "TASK_ROWS", 20)
    rows = [(i % 3, i * 7 % 400, i * 7 % 400 + 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "chrom long, start long, end long")
    assert scale.partitions_of(df) == 50 and scale.partitions_of(df, df) == 100
    for found in (
        intervals.merge_intervals(df, ["chrom"]),
        loci.id_set_diff(df, df.limit(0), ["chrom", "start"], "A", "B"),
        pairs.completeness_check(df, df, ["chrom"], ["start"])[1],
        pairs.presence_check(df, ["chrom"], ["start", "end"], df.select(F.col("start").alias("gene")), "x"),
    ):
        assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sides_with_nulls_and_copies(spark):
    key = "k long, v string"
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y"), (None, None)], key)
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z"), (4, "z"), (None, "q")], key)
    found = loci.id_set_diff(a, b, ["k", "v"], "A", "B")
    # Nulls are equal, as in EXCEPT.
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(3, "y", "A"), (None, None, "A"), (4, "z", "B"), (None, "q", "B")], key=str)
    counts, odd = pairs.completeness_check(a, b, ["k"], ["v"])
    # Here, as in a full join, they are not.
    want = [(2, None, "missing"), (3, "y", "missing"), (None, None, "missing"), (2, None, "unexpected"), (4, "z", "unexpected"), (None, "q", "unexpected")]
    assert sorted(map(tuple, odd.collect()), key=str) == sorted(want, key=str)
    assert {r["k"]: tuple(r)[1:] for r in counts.collect()} == {
        1: (1, 1, 0, 0, 0, 1.0), 2: (1, 1, 0, 1, 1, 0.0), 3: (1, 0, 0, 0, 1, 0.0), 4: (0, 2, 1, 1, 0, None), None: (1, 1, 0, 1, 1, 0.0),
    }
    assert "Join" not in odd._jdf.queryExecution().optimizedPlan().toString()
