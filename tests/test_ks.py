import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from syntabula.functions import draws, peaks as P
from syntabula.operators import ks


def two_hills(n=400, seed=1):
    rng = np.random.default_rng(seed)
    return np.exp(np.r_[rng.normal(math.log(0.27), 0.12, n), rng.normal(math.log(0.95), 0.15, n)]).round(5)


def frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")


def test_find_peaks_rules():
    y = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 4, 4.5, 0])
    assert P.local_maxima(y).tolist() == [1, 4, 7, 9, 11]
    at, prom = P.find_peaks(y, 1, 0)
    assert dict(zip(at.tolist(), prom.tolist())) == {1: 1, 4: 3, 7: 2, 9: 5, 11: 0.5}
    assert P.find_peaks(y, 3, 0)[0].tolist() == [1, 4, 9]
    assert P.find_peaks(y, 1, 2.5)[0].tolist() == [4, 9]
    assert P.local_maxima(np.array([3.0, 1, 2, 2])).tolist() == []


def test_kde_and_peaks_against_brute_force(spark):
    values = two_hills()
    curve = ks.log_kde(frame(spark, {"a": values}), ["k"], "v", (1.0,))
    got = curve.orderBy("i").toPandas()
    x = np.log(values)
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(math.log(0.1), math.log(3), 1601)
    density = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got["density"], density / np.exp(grid), rtol=1e-9)
    assert np.allclose(got["x"], np.exp(grid))
    found = sorted(r["location"] for r in ks.kde_peaks(curve, ["k", "factor"]).collect())
    assert len(found) == 2 and abs(found[0] - 0.27) < 0.03 and abs(found[1] - 0.95) < 0.1


def test_too_few_values_is_an_error(spark):
    with pytest.raises(Exception, match="fewer than 20"):
        ks.log_kde(frame(spark, {"a": [0.2] * 10 + [0.3] * 5}), ["k"], "v").collect()


def clusters(values, tolerance):
    """Plain reading of the rule."""
    found = []
    for value in sorted(values):
        if found and abs(value - float(np.median(found[-1]))) <= tolerance:
            found[-1].append(value)
        else:
            found.append([value])
    return found


def test_cluster_by_running_median(spark):
    rng = np.random.default_rng(11)
    # Chains with steps of exactly the tolerance, ties, and random values.
    cases = [[0.0, 0.1, 0.2, 0.5], [k * 0.125 for k in range(9)], [1.0, 1.0, 1.125, 1.125, 1.25], [0.5]]
    cases += [rng.uniform(0, 1, n).round(2).tolist() for n in (2, 5, 9, 17, 30)]
    df = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(cases)], "i int, v array<double>")
    got = {r["i"]: r["c"] for r in df.select("i", ks.cluster_by_median(F.col("v"), 0.125).alias("c")).collect()}
    assert got == {i: clusters(c, 0.125) for i, c in enumerate(cases)}
    assert len(got[1]) == 5 and len(got[2]) == 2


def test_peaks_of_curves_against_numpy(spark):
    """Distance, plateaus, ties, prominence and rank, on rough and smooth curves."""
    rng = np.random.default_rng(12)
    curves = [rng.integers(0, 6, n).astype(float) for n in (1, 2, 3, 4, 30, 60, 90)]
    curves += [np.zeros(20), np.arange(9.0), np.r_[0, 3, 3, 0, 3, 0, 3, 3, 3, 0], np.abs(np.sin(np.arange(200) / 9)) * np.arange(200), rng.normal(size=80)]
    rows = [(i, float(x), float(y)) for i, c in enumerate(curves) for x, y in enumerate(c)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(5)
    for distance, floor in ((1, 0.0), (3, 0.5), (7, 1.0)):
        expected = []
        for i, c in enumerate(curves):
            at, prom = P.find_peaks(c, distance, max(floor, 0.05 * c.max()))
            order = np.argsort(-prom, kind="stable")
            expected += [(i, r + 1, float(at[o]), float(c[at[o]]), float(prom[o])) for r, o in enumerate(order)]
        got = ks.local_peaks(df, ["k"], "x", "y", distance, floor=floor).orderBy("k", "peak_rank").collect()
        assert [tuple(r) for r in got] == expected


def test_consensus_and_bootstrap(spark):
    df = frame(spark, {"a": two_hills(), "b": two_hills(300, 2)})
    peaks = ks.kde_peaks(ks.log_kde(df, ["k"], "v"), ["k", "factor"])
    references = ks.bandwidth_consensus(peaks, ["k"])
    args = {"replicates": 40}
    small = {(r["k"], r["peak_rank"]): r for r in ks.bootstrap_support(df, references, ["k"], "v", **args).collect()}
    again = {(r["k"], r["peak_rank"]): r for r in ks.bootstrap_support(df.repartition(3), references, ["k"], "v", **args).collect()}
    assert len(small) == 4 and small == again
    for key, row in small.items():
        assert row["valid"] and row["support"] == 1.0 and row["bandwidth_support"] == 5
        assert row["bootstrap_lower"] <= row["bootstrap_median"] <= row["bootstrap_upper"]


def test_bootstrap_does_not_depend_on_other_groups(spark):
    """A group gives the same numbers alone and beside a much larger one."""
    small, large = two_hills(), two_hills(3000, 3)
    both = frame(spark, {"a": small, "b": large})
    references = ks.bandwidth_consensus(ks.kde_peaks(ks.log_kde(both, ["k"], "v"), ["k", "factor"]), ["k"])
    got = [
        [tuple(r) for r in ks.bootstrap_support(df, references.filter("k = 'a'"), ["k"], "v", replicates=20).orderBy("peak_rank").collect()]
        for df in (both, frame(spark, {"a": small}))
    ]
    assert got[0] == got[1]


def test_nearest_within_one_full_bucket(spark):
    """Linear work in one bucket, ties and repeated rows included."""
    n = 40_000
    ref = spark.range(n).selectExpr("'k' AS k", "id", "id * 1e-6 AS x")
    cand = spark.range(n).selectExpr("'k' AS k", "id * 1e-6 + 3e-7 AS y")
    got = ks.nearest_within(ref.union(ref.limit(5)), cand, ["k"], "x", "y", 0.12)
    assert got.count() == n + 5 and got.filter("nearest IS NULL OR abs(nearest - x) > 4e-7").count() == 0


def test_histogram_keeps_groups_out_of_range(spark):
    got = ks.histogram(frame(spark, {"a": [0.1], "b": [7.0, 8.0]}), ["k"], "v")
    assert got.groupBy("k").sum("n").orderBy("k").collect() == [("a", 1), ("b", 0)]


def test_draws_are_poisson_and_repeat(spark):
    """Means and variances of draws: single values, values that occur often, and equal draws in any partitioning."""
    values = [0.2] * 1 + [0.3] * 16 + [0.4] * 17 + [0.9] * 400
    weighted = ks._weighted(frame(spark, {"a": values}), ["k"], "v", ks.SPEC)
    got = ks.resampled_bins(weighted, ["k"], 4000, 7).toPandas()
    again = ks.resampled_bins(weighted.repartition(3), ["k"], 4000, 7).toPandas()
    order = ["replicate", "bin"]
    assert got.sort_values(order, ignore_index=True).equals(again.sort_values(order, ignore_index=True))
    table = got.pivot(index="replicate", columns="bin", values="n").reindex(range(4000)).fillna(0)
    for n, (_, drawn) in zip((1, 16, 17, 400), table.items()):
        assert abs(drawn.mean() - n) < 5 * math.sqrt(n / 4000) and abs(drawn.var() / n - 1) < 0.15
    assert abs(np.corrcoef(table.to_numpy().T) - np.eye(4)).max() < 0.08
    assert np.isclose((table.iloc[:, 0] == 0).mean(), math.exp(-1), atol=0.03)


def test_mixing_is_the_public_finaliser(spark):
    def plain(h):
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
        return h ^ h >> 16

    numbers = [0, 1, 65535, 65536, 2**31, 2**32 - 1, 123456789]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", draws.mix(F.col("n")).alias("m"))
    stepwise = draws.with_uniform(df, "u", (F.col("n"), F.lit(5).cast("long")), F.lit(3).cast("long"))
    rows = stepwise.select("*", draws.uniform((F.col("n"), F.lit(5).cast("long")), F.lit(3).cast("long")).alias("w")).collect()
    assert [r["m"] for r in rows] == [plain(r["n"]) for r in rows]
    assert [r["u"] for r in rows] == [r["w"] for r in rows] == [plain(plain((r["n"] + 3 * draws.STEP) % 2**32) ^ 5) for r in rows]


def test_bootstrap_agrees_with_resampling_with_replacement(spark):
    """Supports and intervals of counter-based draws against numpy's own resamples."""
    values = np.r_[two_hills(120, 4), np.exp(np.random.default_rng(5).normal(math.log(1.9), 0.1, 12)).round(5)]
    values = values[(values >= 0.1) & (values <= 3)]
    df = frame(spark, {"a": values})
    references = ks.bandwidth_consensus(ks.kde_peaks(ks.log_kde(df, ["k"], "v"), ["k", "factor"]), ["k"])
    got = ks.bootstrap_support(df, references, ["k"], "v", replicates=300).orderBy("peak_rank").collect()
    rng, found = np.random.default_rng(6), []
    for _ in range(300):
        sample = rng.choice(values, len(values))
        x = np.log(sample)
        density = P.kernel_sum(ks.SPEC.grid, x, np.ones(len(x)), len(x) ** -0.2 * x.std(ddof=1)) / np.exp(ks.SPEC.grid)
        found.append([p[0] for p in ks.accept_peaks(density, sample.min(), sample.max(), ks.SPEC)])
    for row in got:
        near = [min(c, key=lambda p: abs(math.log(p / row["location"]))) for c in found if c]
        near = [p for p in near if abs(math.log(p / row["location"])) <= 0.12]
        assert abs(row["support"] - len(near) / 300) < 0.12
        assert abs(math.log(row["bootstrap_median"] / np.median(near))) < 0.02
        assert abs(math.log(row["bootstrap_upper"] / np.quantile(near, 0.975))) < 0.05


def test_validated_peaks(spark):
    df = spark.createDataFrame(
        [("c", float(v), 0.1, 20, 0.2 if i % 2 else 0.9) for i, v in enumerate(two_hills())],
        "comparison string, ks_median double, pvalue double, length long, tandem_ratio double",
    )
    got = ks.validated_peaks(ks.filter_blocks(df), ["comparison"], replicates=20).collect()
    assert len(got) == 2 and {r["validation_class"] for r in got} == {"ROBUST"}
    assert all(abs(math.log(r["low_tandem_peak"] / r["location"])) <= 0.12 for r in got)


def test_filter_limits(spark):
    data = [
        ("keep", 0.2, 10, 3.0, 0.5),
        ("pvalue", 0.21, 5, 9.0, 0.1),
        ("length", 0.2, 9, 0.0, 0.1),
        ("nonpositive_ks", 0.1, 10, 0.0, 0.1),
        ("high_ks", 0.1, 10, 3.01, 0.1),
        ("keep_high", 0.0, 99, 0.1, 0.51),
    ]
    df = ks.filter_blocks(spark.createDataFrame(data, "id string, pvalue double, length long, ks_median double, tandem_ratio double"))
    got = {r["id"]: (r["reject_reason"], r["low_tandem"]) for r in df.collect()}
    assert got.pop("keep") == (None, True) and got.pop("keep_high") == (None, False)
    assert all(reason == name and not low for name, (reason, low) in got.items())
    funnel = ks.filter_funnel(df, []).first()
    assert funnel["primary_blocks"] == 2 and funnel["low_tandem_blocks"] == 1 and funnel["failed_high_ks"] == 1


def test_histogram_edges_match_numpy(spark):
    values = [round(k * 0.05, 2) for k in range(61)] + [0.07, 2.99, 1.234]
    hist = ks.histogram(frame(spark, {"a": values}), ["k"], "v").orderBy("bin").collect()
    expected, _ = np.histogram(values, bins=np.arange(0.0, 3.05, 0.05)[:61])
    assert [r["n"] for r in hist] == expected.tolist() and len(hist) == 60
    smooth = ks.smooth_bins(ks.histogram(frame(spark, {"a": values}), ["k"], "v"), ["k"]).orderBy("bin").collect()
    assert np.allclose([r["smooth"] for r in smooth], np.convolve(expected, np.array([1, 2, 3, 2, 1]) / 9, mode="same"))


def test_unbiased_moments(spark):
    row = ks.moments(frame(spark, {"a": [1, 2, 3, 10]}), ["k"], "v").first()
    assert math.isclose(row["skewness"], 1.763632614803888) and math.isclose(row["excess_kurtosis"], 3.228)


def test_audit_flags(spark):
    values = np.r_[np.linspace(0.01, 0.09, 30), two_hills(50)]
    row = ks.distribution_audit(frame(spark, {"a": values}), ["k"], "v").first()
    assert row["boundary_flag"] == "STRONG_LOW_KS_BOUNDARY" and row["near_zero"] == 30
    assert row["single_gaussian_supported"] == "NO" and math.isclose(row["median"], np.median(values))


def test_nearest_within_brute_force(spark):
    rng = np.random.default_rng(8)
    ref, cand = rng.uniform(-1, 1, 60).round(3), rng.uniform(-1, 1, 25).round(3)
    left = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(ref)] + [("z", 99, 0.0)], "k string, i long, x double")
    got = {r["i"]: r["nearest"] for r in ks.nearest_within(left, frame(spark, {"a": cand}), ["k"], "x", "v", 0.05).collect()}
    assert got.pop(99) is None and len(got) == 60
    for i, x in enumerate(ref):
        best = cand[np.argmin(np.abs(cand - x))]
        if abs(best - x) <= 0.05:
            assert math.isclose(abs(got[i] - x), abs(best - x))
        else:
            assert got[i] is None


def test_range_split(spark):
    row = ks.range_split(frame(spark, {"a": [0.05, 0.1, 3.0, 3.1, -1.0, float("nan")]}), ["k"], "v").first()
    assert (row["all_positive"], row["below"], row["inside"], row["above"]) == (4, 1, 2, 1)
    assert (row["inside_minimum"], row["inside_maximum"]) == (0.1, 3.0)


def test_pair_values(spark):
    df = spark.createDataFrame([("b", 3, [0.5, 0.0, 3.0, 3.1])], "id string, length long, ks array<double>")
    got = [tuple(r) for r in ks.pair_values(df, ["id"], F.col("ks")).collect()]
    assert got == [("b", 1, 0.5), ("b", 3, 3.0)]
    assert ks.list_length_mismatches(df, ["id"], F.col("ks")).first()["ks_list_length_mismatches"] == 1
