"""Ks queries.

Stand-ins on the driver tables: a part is a block (line count as length, median
discount x 30 as Ks, mean tax x 4 as p-value, share of flag A as tandem ratio) and
the first digit of its brand the comparison; event values / 100 are Ks values.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import draws as D, values as V
from ..operators import ks
from ..operators.scale import exact_quantiles
from .homology import lines, rounded
from .registry import query, table

BLOCKS_SQL = """
bl AS (
  SELECT substr(p_brand, 7, 1) AS comparison, p_partkey AS block_id, count(*) AS length, median(l_discount * 30) AS ks_median,
    round(avg(l_tax * 4), 9) AS pvalue, count(*) FILTER (l_returnflag = 'A') / count(*) AS tandem_ratio
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), jb AS (
  SELECT *, CASE WHEN pvalue > 0.2 THEN 'pvalue' WHEN length < 10 THEN 'length' WHEN ks_median <= 0 THEN 'nonpositive_ks'
    WHEN ks_median > 2.5 THEN 'high_ks' END AS reject_reason FROM bl
), fb AS (SELECT *, reject_reason IS NULL AND tandem_ratio <= 0.375 AS low_tandem FROM jb)"""


def blocks(spark, sf):
    df = lines(spark, sf).select("l_partkey", "l_returnflag", (F.col("l_discount") * 30).alias("ks"), "l_tax")
    flat = df.groupBy("l_partkey").agg(
        F.count("*").alias("length"),
        # Rounded: the mean of taxes meets the limit exactly at times, and the order of
        # summation must not decide then.
        F.round(F.avg(F.col("l_tax") * 4), 9).alias("pvalue"),
        (F.count_if(F.col("l_returnflag") == "A") / F.count("*")).alias("tandem_ratio"),
    )
    medians = exact_quantiles(df, ["l_partkey"], "ks", {"ks_median": 0.5})
    part = table(spark, sf, "part").select("p_partkey", F.substring("p_brand", 7, 1).alias("comparison"))
    return (
        flat.join(medians, "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("comparison", F.col("l_partkey").alias("block_id"), "length", "ks_median", "pvalue", "tandem_ratio")
    )


def judged(spark, sf):
    return ks.filter_blocks(blocks(spark, sf), max_ks=2.5, max_tandem=0.375)


@query(
    "block_filter",
    f"""WITH {BLOCKS_SQL} SELECT comparison, block_id, length, round(ks_median, 8) AS ks_median, pvalue,
      round(tandem_ratio, 8) AS tandem_ratio, reject_reason, low_tandem FROM fb""",
)
def block_filter(spark, sf):
    return rounded(judged(spark, sf), "ks_median", "tandem_ratio")


@query(
    "filter_funnel",
    f"""WITH {BLOCKS_SQL} SELECT comparison, count(*) AS raw_blocks, count(*) FILTER (reject_reason = 'pvalue') AS failed_pvalue,
      count(*) FILTER (reject_reason = 'length') AS failed_length, count(*) FILTER (reject_reason = 'nonpositive_ks') AS failed_nonpositive_ks,
      count(*) FILTER (reject_reason = 'high_ks') AS failed_high_ks, count(*) FILTER (reject_reason IS NULL) AS primary_blocks,
      round(count(*) FILTER (reject_reason IS NULL) / count(*), 8) AS primary_fraction, count(*) FILTER (low_tandem) AS low_tandem_blocks,
      count(*) FILTER (reject_reason IS NULL AND NOT low_tandem) AS high_tandem_blocks FROM fb GROUP BY ALL""",
)
def filter_funnel(spark, sf):
    return rounded(ks.filter_funnel(judged(spark, sf), ["comparison"]), "primary_fraction")


CELLS_SQL = "cells AS (SELECT l_orderkey AS block_id, l_linenumber, l_partkey, l_discount * 30 AS v FROM lineitem)"


@query(
    "pair_values",
    """SELECT block_id, pair_index, round(v, 8) AS pair_ks FROM (
      SELECT l_orderkey AS block_id, l_discount * 30 AS v, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS INTEGER) AS pair_index FROM lineitem)
    WHERE v > 0 AND v <= 2.5""",
)
def pair_values(spark, sf):
    cells = lines(spark, sf).groupBy(F.col("l_orderkey").alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))).alias("g")
    )
    text = F.concat_ws("_", F.transform("g", lambda e: (e["l_discount"] * 30).cast("string")))
    return rounded(ks.pair_values(cells, ["block_id"], V.parse_value_list(text), 2.5), "pair_ks")


EVENTS_SQL = "ev AS (SELECT event_type, value / 100 AS ks FROM events)"


def event_values(spark, sf):
    return table(spark, sf, "events").select("event_type", (F.col("value") / 100).alias("ks"))


@query(
    "range_split",
    f"""WITH {EVENTS_SQL} SELECT event_type, count(*) AS all_positive, count(*) FILTER (ks < 0.1) AS below,
      count(*) FILTER (ks >= 0.1 AND ks <= 3) AS inside, count(*) FILTER (ks > 3) AS above,
      round(count(*) FILTER (ks < 0.1) / count(*), 8) AS fraction_below, round(count(*) FILTER (ks >= 0.1 AND ks <= 3) / count(*), 8) AS fraction_inside,
      round(count(*) FILTER (ks > 3) / count(*), 8) AS fraction_above, round(min(ks), 8) AS minimum,
      round(min(ks) FILTER (ks >= 0.1 AND ks <= 3), 8) AS inside_minimum, round(max(ks) FILTER (ks >= 0.1 AND ks <= 3), 8) AS inside_maximum
    FROM ev WHERE ks > 0 GROUP BY ALL""",
)
def range_split(spark, sf):
    split = ks.range_split(event_values(spark, sf), ["event_type"], "ks")
    return rounded(split, *[c for c in split.columns if c.startswith(("fraction", "min", "inside_m"))])


HISTOGRAM_SQL = """
g AS (SELECT event_type, ks, CAST(floor(ks / 0.05) AS BIGINT) AS b FROM ev WHERE ks BETWEEN 0 AND 3),
h AS (SELECT event_type, least(59, b - CASE WHEN ks < b * CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END
  + CASE WHEN ks >= (b + 1) * CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) AS bin, count(*) AS n FROM g GROUP BY ALL),
hd AS (SELECT e.event_type, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM ev) e
  CROSS JOIN (SELECT unnest(generate_series(0, 59)) AS bin) b LEFT JOIN h ON h.event_type = e.event_type AND h.bin = b.bin)"""


@query(
    "histogram",
    f"WITH {EVENTS_SQL}, {HISTOGRAM_SQL} SELECT event_type, bin, CAST((bin + 0.5) * 0.05 AS DOUBLE) AS center, n FROM hd",
)
def histogram(spark, sf):
    return rounded(ks.histogram(event_values(spark, sf), ["event_type"], "ks"), "center")


@query(
    "smooth_bins",
    f"""WITH {EVENTS_SQL}, {HISTOGRAM_SQL} SELECT event_type, bin, CAST((bin + 0.5) * 0.05 AS DOUBLE) AS center, n,
      round((coalesce(lag(n, 2) OVER w, 0) + 2 * coalesce(lag(n) OVER w, 0) + 3 * n + 2 * coalesce(lead(n) OVER w, 0)
        + coalesce(lead(n, 2) OVER w, 0)) / 9, 8) AS smooth FROM hd WINDOW w AS (PARTITION BY event_type ORDER BY bin)""",
)
def smooth_bins(spark, sf):
    hist = ks.histogram(event_values(spark, sf), ["event_type"], "ks")
    return rounded(ks.smooth_bins(hist, ["event_type"]), "center", "smooth")


def peaks_sql(name: str, curve: str, keys: str, x: str, y: str, distance: int, more: str = "") -> str:
    """CTEs that end in `name`: keys, location, height, prominence, place, top and more, before any threshold."""
    same = " AND ".join(f"k.{c} = r.{c}" for c in keys.split(", "))
    own = ", ".join(f"k.{c}" for c in keys.split(", "))
    return f"""{name}_i AS (SELECT {keys}{more}, {x} AS x, {y} AS y, row_number() OVER w - 1 AS i, CASE WHEN lag({y}) OVER w = {y} THEN 0 ELSE 1 END AS new
  FROM {curve} WINDOW w AS (PARTITION BY {keys} ORDER BY {x})),
{name}_g AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM {name}_i),
{name}_r AS (SELECT {keys}, run, min(i) AS a, max(i) AS b, any_value(y) AS h FROM {name}_g GROUP BY {keys}, run),
{name}_n AS (SELECT *, lag(h) OVER w AS before, lead(h) OVER w AS after FROM {name}_r WINDOW w AS (PARTITION BY {keys} ORDER BY run)),
{name}_t AS (SELECT {keys}, unnest(list_reduce(list([{{'at': (a + b) // 2, 'h': h, 'run': run}}] ORDER BY h DESC, (a + b) // 2 DESC),
    lambda taken, c: CASE WHEN len(list_filter(taken, lambda t: abs(t.at - c[1].at) < {distance})) > 0 THEN taken ELSE list_concat(taken, c) END)) AS p
  FROM {name}_n WHERE h > before AND h > after GROUP BY {keys}),
{name}_k AS (SELECT {keys}, p.at AS place, p.h AS height, p.run AS run FROM {name}_t),
{name}_s AS (SELECT {own}, place, height, k.run, max(r.run) FILTER (r.run < k.run AND r.h > height) AS lo, min(r.run) FILTER (r.run > k.run AND r.h > height) AS hi
  FROM {name}_k k JOIN {name}_r r ON {same} GROUP BY ALL),
{name}_p AS (SELECT {own}, place, height, height - greatest(min(r.h) FILTER (r.run <= k.run AND r.run > coalesce(lo, 0)),
    min(r.h) FILTER (r.run >= k.run AND r.run < coalesce(hi, k.run + 1000000))) AS prominence FROM {name}_s k JOIN {name}_r r ON {same} GROUP BY {own}, place, height, k.run, lo, hi),
{name} AS (SELECT {own}, r.x AS location, height, prominence, place{more.replace(", ", ", r.")},
    (SELECT max(y) FROM {name}_i z WHERE {same.replace("r.", "z.")}) AS top FROM {name}_p k JOIN {name}_i r ON {same} AND r.i = k.place)"""


#: Smoothed in the order of the operator's terms, so that equal heights stay equal.
SMOOTH_SQL = """sm AS (SELECT event_type, bin, CAST((bin + 0.5) * 0.05 AS DOUBLE) AS center, n,
  coalesce(lag(n, 2) OVER w, 0) * CAST(%r AS DOUBLE) + coalesce(lag(n) OVER w, 0) * CAST(%r AS DOUBLE) + n * CAST(%r AS DOUBLE)
  + coalesce(lead(n) OVER w, 0) * CAST(%r AS DOUBLE) + coalesce(lead(n, 2) OVER w, 0) * CAST(%r AS DOUBLE) AS smooth
  FROM hd WINDOW w AS (PARTITION BY event_type ORDER BY bin))""" % tuple(w / 9 for w in (1.0, 2.0, 3.0, 2.0, 1.0))
LOCAL_PEAKS_SQL = f"""{HISTOGRAM_SQL}, {SMOOTH_SQL}, {peaks_sql("lp", "sm", "event_type", "center", "smooth", 3)}"""


@query(
    "local_peaks",
    f"""WITH {EVENTS_SQL}, {LOCAL_PEAKS_SQL} SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY prominence DESC, place) AS INTEGER) AS peak_rank,
      round(location, 8) AS location, round(height, 8) AS height, round(prominence, 8) AS prominence FROM lp WHERE prominence >= greatest(2.0, top * 0.05)""",
)
def local_peaks(spark, sf):
    hist = ks.histogram(event_values(spark, sf), ["event_type"], "ks")
    found = ks.local_peaks(ks.smooth_bins(hist, ["event_type"]), ["event_type"], "center", "smooth", 3, floor=2.0)
    return rounded(found, "location", "height", "prominence")


@query(
    "distribution_moments",
    f"""WITH {EVENTS_SQL}, m AS (SELECT event_type, count(*) AS n, min(ks) AS mn, max(ks) AS mx, avg(ks) AS mean, stddev_samp(ks) AS sd,
      skewness(ks) AS skew, kurtosis(ks) AS kurt FROM ev WHERE ks > 0 AND ks <= 3 GROUP BY ALL)
    SELECT event_type, n, round(mn, 6) AS minimum, round(mx, 6) AS maximum, round(mean, 6) AS mean, round(sd, 6) AS sd,
      round(skew, 6) AS skewness, round(kurt, 6) AS excess_kurtosis FROM m""",
)
def distribution_moments(spark, sf):
    kept = event_values(spark, sf).filter("ks > 0 AND ks <= 3")
    moments = ks.moments(kept, ["event_type"], "ks")
    return rounded(moments, *[c for c in moments.columns if c not in ("event_type", "n")], digits=6)


@query(
    "exact_quartiles",
    f"""WITH {EVENTS_SQL} SELECT event_type, round(quantile_cont(ks, 0.25), 8) AS q1, round(quantile_cont(ks, 0.5), 8) AS median,
      round(quantile_cont(ks, 0.75), 8) AS q3 FROM ev GROUP BY ALL""",
)
def exact_quartiles(spark, sf):
    found = exact_quantiles(event_values(spark, sf), ["event_type"], "ks", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return rounded(found, "q1", "median", "q3")


@query(
    "distribution_audit",
    f"""WITH ev AS (SELECT event_type, value / 100 AS ks FROM events WHERE value / 100 > 0 AND value / 100 <= 3), {LOCAL_PEAKS_SQL},
    m AS (SELECT event_type, count(*) AS n, min(ks) AS minimum, max(ks) AS maximum, avg(ks) AS mean, stddev_samp(ks) AS sd, skewness(ks) AS skewness,
      kurtosis(ks) AS excess_kurtosis, count(*) FILTER (ks <= 0.1) AS near_zero, count(*) FILTER (ks >= 2.9) AS high_boundary,
      quantile_cont(ks, 0.25) AS q1, quantile_cont(ks, 0.5) AS median, quantile_cont(ks, 0.75) AS q3 FROM ev GROUP BY ALL),
    md AS (SELECT event_type, arg_max(center, [n, -bin]) AS histogram_mode FROM sm GROUP BY ALL),
    np AS (SELECT event_type, count(*) AS candidate_peaks FROM lp WHERE prominence >= greatest(2.0, top * 0.05) GROUP BY ALL),
    fl AS (SELECT m.*, histogram_mode, coalesce(candidate_peaks, 0) AS candidate_peaks, near_zero / n AS near_zero_fraction, high_boundary / n AS high_boundary_fraction,
      CASE coalesce(candidate_peaks, 0) WHEN 0 THEN 'NO_CLEAR_INTERNAL_PEAK' WHEN 1 THEN 'ONE_CANDIDATE_PEAK' ELSE 'MULTIMODAL_CANDIDATE' END AS distribution_flag,
      CASE WHEN near_zero / n >= 0.2 THEN 'STRONG_LOW_KS_BOUNDARY' WHEN high_boundary / n >= 0.1 THEN 'STRONG_HIGH_KS_BOUNDARY' ELSE 'NO_STRONG_BOUNDARY' END AS boundary_flag
      FROM m JOIN md USING (event_type) LEFT JOIN np USING (event_type))
    SELECT event_type, n, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(mean, 6) AS mean, round(sd, 6) AS sd, round(skewness, 6) AS skewness,
      round(excess_kurtosis, 6) AS excess_kurtosis, near_zero, high_boundary, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(histogram_mode, 6) AS histogram_mode, candidate_peaks, round(near_zero_fraction, 6) AS near_zero_fraction, round(high_boundary_fraction, 6) AS high_boundary_fraction,
      distribution_flag, boundary_flag,
      CASE WHEN candidate_peaks = 1 AND abs(skewness) <= 1 AND boundary_flag = 'NO_STRONG_BOUNDARY' THEN 'POSSIBLY' ELSE 'NO' END AS single_gaussian_supported FROM fl""",
)
def distribution_audit(spark, sf):
    audit = ks.distribution_audit(event_values(spark, sf), ["event_type"], "ks")
    return rounded(audit, *[f.name for f in audit.schema if f.dataType.typeName() == "double"], digits=6)


@query(
    "blockinfo_qc",
    f"""WITH {BLOCKS_SQL} SELECT b.comparison, count(*) AS blockinfo_rows, count(*) FILTER (ks_median > 0) AS ks_finite,
      count(*) FILTER (ks_median <= 0) AS ks_missing, CAST(0 AS BIGINT) AS ks_nonnumeric, CAST(0 AS BIGINT) AS ks_nan, CAST(0 AS BIGINT) AS ks_infinite, any_value(expected_blocks) AS expected_blocks,
      CASE WHEN count(*) = any_value(expected_blocks) AND count(*) FILTER (ks_median > 0) = count(*) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM bl b JOIN (SELECT substr(p_brand, 7, 1) AS comparison, count(*) AS expected_blocks FROM part GROUP BY ALL) e
      ON e.comparison = b.comparison GROUP BY b.comparison""",
)
def blockinfo_qc(spark, sf):
    cell = F.when(F.col("ks_median") > 0, F.col("ks_median").cast("string")).otherwise("")
    typed = blocks(spark, sf).withColumn("kind", V.classify_number(cell)["class"])
    expected = table(spark, sf, "part").groupBy(F.substring("p_brand", 7, 1).alias("comparison")).agg(
        F.count("*").alias("expected_blocks")
    )
    return ks.blockinfo_qc(typed, ["comparison"], F.col("kind"), expected)


GRID_STEP = (math.log(3.0) - math.log(0.1)) / 1600


@query(
    "log_kde",
    f"""WITH {EVENTS_SQL}, k AS (SELECT event_type, ln(ks) AS x, count(*) AS w FROM ev WHERE ks BETWEEN 0.1 AND 3 GROUP BY ALL),
    s AS (SELECT event_type, count(*) AS n, stddev_samp(ln(ks)) AS sd, min(ks) AS mn, max(ks) AS mx FROM ev WHERE ks BETWEEN 0.1 AND 3 GROUP BY ALL),
    f AS (SELECT *, factor * sd * pow(n, -0.2) AS h FROM s CROSS JOIN (SELECT unnest([CAST(0.6 AS DOUBLE), 1.5]) AS factor)),
    g AS (SELECT i, ln(CAST(0.1 AS DOUBLE)) + i * CAST({GRID_STEP!r} AS DOUBLE) AS lx FROM (SELECT unnest(generate_series(0, 1600)) AS i))
    SELECT f.event_type, factor, CAST(i AS INTEGER) AS i, round(exp(lx), 8) AS x,
      round(sum(w * exp(-0.5 * pow((lx - x) / h, 2))) / any_value(n) / any_value(h) / sqrt(2 * pi()) / exp(lx), 6) AS density,
      any_value(mn) AS observed_min, any_value(mx) AS observed_max
    FROM f JOIN k ON k.event_type = f.event_type CROSS JOIN g GROUP BY f.event_type, factor, i, lx""",
)
def log_kde(spark, sf):
    curve = ks.log_kde(event_values(spark, sf), ["event_type"], "ks", (0.6, 1.5))
    return rounded(rounded(curve, "x"), "density", digits=6)


def _event_peaks(spark, sf):
    return ks.kde_peaks(ks.log_kde(event_values(spark, sf), ["event_type"], "ks"), ["event_type", "factor"])


def kde_sql(values: str, key: str, value: str, factors: str) -> str:
    """CTEs that end in `dn`: the density of ln(value) on the grid for each factor."""
    return f"""kw AS (SELECT {key}, ln({value}) AS x, count(*) AS w FROM {values} WHERE {value} BETWEEN 0.1 AND 3 GROUP BY ALL),
ks AS (SELECT {key}, count(*) AS n, stddev_samp(ln({value})) AS sd, min({value}) AS mn, max({value}) AS mx FROM {values} WHERE {value} BETWEEN 0.1 AND 3 GROUP BY ALL),
kf AS (SELECT *, factor * sd * pow(n, -0.2) AS h FROM ks CROSS JOIN (SELECT unnest({factors}) AS factor)),
kg AS (SELECT i, ln(CAST(0.1 AS DOUBLE)) + i * CAST({GRID_STEP!r} AS DOUBLE) AS lx FROM (SELECT unnest(generate_series(0, 1600)) AS i)),
dn AS (SELECT kf.{key}, factor, i, exp(lx) AS x, sum(w * exp(-0.5 * pow((lx - x) / h, 2))) / any_value(n) / any_value(h) / sqrt(2 * pi()) / exp(lx) AS density,
  any_value(mn) AS observed_min, any_value(mx) AS observed_max FROM kf JOIN kw ON kw.{key} = kf.{key} CROSS JOIN kg GROUP BY kf.{key}, factor, i, lx)"""


FACTORS_SQL = f"CAST({list(ks.FACTORS)} AS DOUBLE[])"


def kde_peaks_sql(key: str) -> str:
    """CTEs that end in `kp`: accepted peaks of the densities in `dn`."""
    return f"""{peaks_sql("dp", "dn", f"{key}, factor", "x", "density", ks.SPEC.distance, ", observed_min, observed_max")},
kp AS (SELECT {key}, factor, row_number() OVER (PARTITION BY {key}, factor ORDER BY prominence DESC, place) AS peak_rank, location, ln(location) AS log_location, height, prominence
  FROM dp WHERE top > 0 AND prominence >= top * 0.05 AND location BETWEEN observed_min AND observed_max AND location > 0.1 * 1.01 AND location < 3 / 1.01)"""


def consensus_sql(key: str) -> str:
    """CTEs that end in `bc`: clusters of the peaks in `kp` around a moving median, with enough factors."""
    middle = lambda c: f"({c}[(len({c}) + 1) // 2] + {c}[len({c}) // 2 + 1]) / 2"
    return f"""cl AS (SELECT {key}, list_reduce(list([[log_location]] ORDER BY log_location), lambda c, v: CASE
    WHEN abs(v[1][1] - {middle("c[len(c)]")}) <= 0.12 THEN list_concat(c[1:len(c) - 1], [list_concat(c[len(c)], v[1])]) ELSE list_concat(c, v) END) AS c FROM kp GROUP BY {key}),
cu AS (SELECT {key}, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM cl),
cm AS (SELECT {key}, i, {middle("c")} AS centre FROM cu),
cs AS (SELECT cm.{key}, i, centre, count(DISTINCT factor) AS support FROM cm JOIN kp ON kp.{key} = cm.{key} AND abs(log_location - centre) <= 0.12 GROUP BY ALL),
bc AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) AS INTEGER) AS peak_rank, exp(centre) AS location, centre AS log_location,
  CAST(support AS INTEGER) AS bandwidth_support FROM cs WHERE support >= 3)"""


EVENT_PEAKS_SQL = f"{EVENTS_SQL}, {kde_sql('ev', 'event_type', 'ks', FACTORS_SQL)}, {kde_peaks_sql('event_type')}"


@query(
    "kde_peaks",
    f"""WITH {EVENT_PEAKS_SQL} SELECT event_type, factor, CAST(peak_rank AS INTEGER) AS peak_rank, round(location, 8) AS location, round(log_location, 8) AS log_location,
      round(height, 6) AS height, round(prominence, 6) AS prominence FROM kp""",
)
def kde_peaks(spark, sf):
    return rounded(rounded(_event_peaks(spark, sf), "location", "log_location"), "height", "prominence", digits=6)


@query(
    "bandwidth_consensus",
    f"""WITH {EVENT_PEAKS_SQL}, {consensus_sql("event_type")} SELECT event_type, peak_rank, round(location, 8) AS location, round(log_location, 8) AS log_location,
      bandwidth_support FROM bc""",
)
def bandwidth_consensus(spark, sf):
    return rounded(ks.bandwidth_consensus(_event_peaks(spark, sf), ["event_type"]), "location", "log_location")


def _block_peaks(spark, sf):
    kept = judged(spark, sf).filter("reject_reason IS NULL")
    curve = ks.log_kde(kept, ["comparison"], "ks_median")
    return kept, ks.bandwidth_consensus(ks.kde_peaks(curve, ["comparison", "factor"]), ["comparison"])


def bootstrap_sql(key: str, replicates: int = 500, seed: int = 20260805) -> str:
    """CTEs that end in `bs`: draws of the values in `kw` by counter, densities and peaks of each replicate, recoveries of the peaks in `bc`."""
    number = lambda counter: D.mix_sql("xor(" + D.mix_sql(f"(a + ({counter}) * {D.STEP}) % {D.WORD}") + ", z)")
    events = " + ".join(f"CAST(u >= {step} AS BIGINT)" for step in D.poisson_steps())
    return f"""bv AS (SELECT {key}, v, w, CAST(floor((ln(v) - ln(CAST(0.1 AS DOUBLE))) / CAST({GRID_STEP!r} AS DOUBLE) + 0.5) AS INTEGER) AS bin,
    md5(concat_ws('|', '{seed}', {key}, CAST(floor(v / CAST(1e-9 AS DOUBLE)) AS BIGINT))) AS d
  FROM (SELECT {key}, ks AS v, count(*) AS w FROM vv WHERE ks BETWEEN 0.1 AND 3 GROUP BY ALL)),
bk AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS z FROM bv),
br AS (SELECT {key}, w, bin, a, z, r FROM bk CROSS JOIN (SELECT unnest(generate_series(0, {replicates - 1})) AS r)),
be AS (SELECT {key}, w, bin, a, r, {number("r * 64 + j")} AS u FROM
  (SELECT *, unnest(generate_series(1, CASE WHEN w <= {D.SINGLY} THEN w ELSE {D.UNIFORMS} END)) AS j FROM br)),
bd AS (SELECT {key}, r, bin, CASE WHEN w <= {D.SINGLY} THEN CAST(sum({events}) AS BIGINT)
    ELSE greatest(0, CAST(floor(w + sqrt(w) * (CAST(sum(u) AS DOUBLE) / {float(D.WORD)} - {D.UNIFORMS / 2}) + 0.5) AS BIGINT)) END AS n FROM be GROUP BY {key}, r, bin, w, a),
bb AS (SELECT {key}, r, bin, CAST(sum(n) AS DOUBLE) AS n FROM bd WHERE n > 0 GROUP BY ALL),
bw AS (SELECT {key}, r, sum(n) AS total, sum(n * bin) / sum(n) AS mean, min(bin) AS lo, max(bin) AS hi FROM bb GROUP BY ALL),
bh AS (SELECT bw.{key}, bw.r, any_value(lo) AS lo, any_value(hi) AS hi, pow(any_value(total), -0.2) * sqrt(sum(n * (bin - mean) * (bin - mean)) / (any_value(total) - 1)) AS h
  FROM bb JOIN bw ON bw.{key} = bb.{key} AND bw.r = bb.r GROUP BY bw.{key}, bw.r HAVING any_value(total) > 1),
bc_curve AS (SELECT bh.{key}, bh.r, kg.i, exp(lx) AS x, sum(n * exp(-0.5 * ((kg.i - bin) / h) * ((kg.i - bin) / h))) / exp(lx) AS density,
    exp(ln(CAST(0.1 AS DOUBLE)) + any_value(lo) * CAST({GRID_STEP!r} AS DOUBLE)) AS observed_min, exp(ln(CAST(0.1 AS DOUBLE)) + any_value(hi) * CAST({GRID_STEP!r} AS DOUBLE)) AS observed_max
  FROM bh JOIN bb ON bh.{key} = bb.{key} AND bh.r = bb.r CROSS JOIN kg WHERE h > 0 GROUP BY bh.{key}, bh.r, kg.i, lx),
{peaks_sql("bp", "bc_curve", f"{key}, r", "x", "density", ks.SPEC.distance, ", observed_min, observed_max")},
bf AS (SELECT {key}, r, location FROM bp WHERE top > 0 AND prominence >= top * 0.05 AND location >= observed_min * (1 - 1e-12)
  AND location <= observed_max * (1 + 1e-12) AND location > 0.1 * 1.01 AND location < 3 / 1.01),
bm AS (SELECT bc.{key}, peak_rank, r, arg_min(bf.location, abs(ln(bf.location) - log_location)) AS seen FROM bc JOIN bf ON bc.{key} = bf.{key}
  AND abs(ln(bf.location) - log_location) <= 0.12 GROUP BY ALL),
bn AS (SELECT {key}, peak_rank, count(*) AS recoveries, quantile_cont(seen, 0.5) AS bootstrap_median, quantile_cont(seen, 0.025) AS bootstrap_lower,
  quantile_cont(seen, 0.975) AS bootstrap_upper FROM bm GROUP BY ALL),
bs AS (SELECT bc.*, coalesce(recoveries, 0) AS recoveries, bootstrap_median, bootstrap_lower, bootstrap_upper, mn AS observed_min, mx AS observed_max,
    coalesce(recoveries, 0) / {replicates} AS support,
    coalesce(coalesce(recoveries, 0) / {replicates} >= 0.6 AND bootstrap_median BETWEEN mn AND mx, false) AS valid
  FROM bc JOIN ks ON ks.{key} = bc.{key} LEFT JOIN bn ON bn.{key} = bc.{key} AND bn.peak_rank = bc.peak_rank)"""


def support_sql(values: str, key: str) -> str:
    """All CTEs from the values (key, ks) in the query `values` to `bs`."""
    return f"""vv AS ({values}), {kde_sql("vv", key, "ks", FACTORS_SQL)}, {kde_peaks_sql(key)}, {consensus_sql(key)}, {bootstrap_sql(key)}"""


SUPPORT_COLUMNS = ("location", "log_location", "bootstrap_median", "bootstrap_lower", "bootstrap_upper", "observed_min", "observed_max", "support")


@query(
    "bootstrap_support",
    f"""WITH {BLOCKS_SQL}, {support_sql("SELECT comparison, ks_median AS ks FROM fb WHERE reject_reason IS NULL", "comparison")}
    SELECT comparison, peak_rank, bandwidth_support, recoveries, valid, {", ".join(f"round({c}, 8) AS {c}" for c in SUPPORT_COLUMNS)} FROM bs""",
)
def bootstrap_support(spark, sf):
    kept, references = _block_peaks(spark, sf)
    return rounded(ks.bootstrap_support(kept, references, ["comparison"], "ks_median"), *SUPPORT_COLUMNS)


@query("validated_peaks")
def validated_peaks(spark, sf):
    return ks.validated_peaks(judged(spark, sf), ["comparison"])


@query(
    "nearest_within",
    """WITH c AS (SELECT p_size, p_retailprice AS x FROM part), r AS (SELECT l_orderkey, l_linenumber, p_size, l_extendedprice / l_quantity AS x
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    u AS (SELECT DISTINCT p_size, x FROM c),
    b AS (SELECT r.*, u.x AS below FROM r ASOF LEFT JOIN u ON u.p_size = r.p_size AND u.x <= r.x),
    a AS (SELECT b.*, u.x AS above FROM b ASOF LEFT JOIN u ON u.p_size = b.p_size AND u.x >= b.x)
    SELECT l_orderkey, l_linenumber, CASE WHEN below IS NOT NULL AND x - below <= 5 AND (above IS NULL OR x - below <= above - x) THEN below
      WHEN above - x <= 5 THEN above END AS nearest FROM a""",
)
def nearest_within(spark, sf):
    part = table(spark, sf, "part")
    ref = (
        lines(spark, sf)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("p_size", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    )
    cand = part.select("p_size", F.col("p_retailprice").alias("price"))
    return ks.nearest_within(ref, cand, ["p_size"], "x", "price", 5.0).select("l_orderkey", "l_linenumber", "nearest")
