"""Queries of interval joins, rank statistics, aggregates and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coopspark.functions import scalars as S
from coopspark.operators import annotate, intervals, rankstats, report, training
from coopspark.operators.quantiles import quantiles
from coopspark.plans.adapters import view, with_views
from coopspark.plans.base import query
from coopspark.plans.scalar_queries import _KNOWN, _MATRIX, cofactor_matrix, known_reference

B = 21_600  # bin width of the interval queries: half a region


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- intervals ---------------------------------------------------------------


@query(f"""{with_views('regions', 'hits')} SELECT DISTINCT r.chrom, r.start, r."end", h.start AS start_hit, h."end" AS end_hit, h.tf AS tf_hit, h.score AS score_hit, h.start - r.start AS start_rel
  FROM regions r JOIN hits h ON r.chrom = h.chrom AND h.start >= r.start AND h."end" <= r."end" WHERE h.score >= 100""")
def j1_f2_p9_contained(spark, sf):
    regions = view(spark, sf, "regions").select("chrom", "start", "end")
    hits = view(spark, sf, "hits").where("score >= 100").select("chrom", "start", "end", "tf", "score")
    return intervals.contained(regions, hits, B).select("chrom", "start", "end", "start_hit", "end_hit", "tf_hit", "score_hit", (F.col("start_hit") - F.col("start")).alias("start_rel"))


SIGNAL_SQL = """per AS (SELECT r.chrom, r.start, r."end", t.track, abs(sum(t.value * (least(r."end", t."end") - greatest(r.start, t.start)))) AS part
  FROM (SELECT DISTINCT chrom, start, "end" FROM regions) r JOIN tracks t ON r.chrom = t.chrom AND r.start < t."end" AND t.start < r."end" GROUP BY ALL),
  total AS (SELECT chrom, start, "end", sum(part) AS signal FROM per GROUP BY ALL)"""


@query(f"""{with_views('regions', 'tracks')}, {SIGNAL_SQL} SELECT chrom, start, "end", event_id, round(coalesce(signal, 0), 4) AS signal FROM regions LEFT JOIN total USING (chrom, start, "end")""")
def j2_a1_signal(spark, sf):
    tracks = view(spark, sf, "tracks").select("chrom", "start", "end", "value", "track")
    return rounded(intervals.signal_by_region(view(spark, sf, "regions"), tracks, B), "signal", digits=4)


@query(f"""{with_views('regions', 'tracks')}, {SIGNAL_SQL} SELECT chrom, start, "end", event_id, CASE WHEN start >= 0 AND "end" <= size THEN round(coalesce(signal, 0), 4) ELSE 0 END AS signal
  FROM regions LEFT JOIN total USING (chrom, start, "end") LEFT JOIN (SELECT chrom, max("end") - 100000 AS size FROM regions WHERE chrom <> '7' GROUP BY chrom) USING (chrom)""")
def f15_in_bounds(spark, sf):
    regions = view(spark, sf, "regions")
    sizes = regions.where("chrom <> '7'").groupBy("chrom").agg((F.max("end") - 100_000).alias("size"))
    tracks = view(spark, sf, "tracks").select("chrom", "start", "end", "value", "track")
    return rounded(intervals.signal_by_region(regions, tracks, B, sizes), "signal", digits=4)


@query(f"""{with_views('regions', 'hits', 'tracks')}, h AS (SELECT DISTINCT concat(r.chrom, ':', r.start) AS region, h.tf FROM regions r JOIN hits h ON r.chrom = h.chrom AND h.start >= r.start AND h."end" <= r."end"),
  seen AS (SELECT DISTINCT concat(r.chrom, ':', r.start) AS region, upper(t.track) AS tf FROM regions r JOIN tracks t ON r.chrom = t.chrom AND r.start < t."end" AND t.start < r."end" WHERE t.event_id % 3 = 0)
  SELECT region, tf, (region, split_part(tf, '::', 1)) IN (SELECT (region, tf) FROM seen) AND (region, list_last(string_split(tf, '::'))) IN (SELECT (region, tf) FROM seen) AS evidence FROM h""")
def j3_f4_evidence(spark, sf):
    regions = view(spark, sf, "regions").select("chrom", "start", "end").distinct()
    met = intervals.contained(regions, view(spark, sf, "hits").select("chrom", "start", "end", "tf"), B)
    hits = met.select(F.concat("chrom", F.lit(":"), F.col("start").cast("string")).alias("region"), "chrom", F.col("start").alias("region_start"), F.col("end").alias("region_end"), F.col("tf_hit").alias("tf")).distinct()
    peaks = view(spark, sf, "tracks").where("event_id % 3 = 0").select("chrom", "start", "end", F.col("track").alias("tf"))
    return intervals.chip_evidence(hits, peaks, B).select("region", "tf", "evidence")


GAPS_SQL = """r AS (SELECT DISTINCT chrom, start, "end" FROM regions), cut AS (SELECT r.*, greatest(r.start, h.start) AS s, least(r."end", h."end") AS e FROM r JOIN hits h ON r.chrom = h.chrom AND r.start < h."end" AND h.start < r."end"),
  w AS (SELECT *, max(e) OVER (PARTITION BY chrom, start, "end" ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
  gaps AS (SELECT chrom, start, "end", coalesce(before, start) AS gap_start, s AS gap_end FROM w WHERE s > coalesce(before, start)
    UNION ALL SELECT chrom, start, "end", coalesce(max(e), start), "end" FROM r LEFT JOIN cut USING (chrom, start, "end") GROUP BY chrom, start, "end" HAVING coalesce(max(e), start) < "end")"""


@query(f"{with_views('regions', 'hits')}, {GAPS_SQL} SELECT * FROM gaps")
def j4_subtract(spark, sf):
    return intervals.subtract(view(spark, sf, "regions"), view(spark, sf, "hits"), B)


@query(f"""{with_views('regions', 'tracks')}, s AS (SELECT chrom, (start + "end") // 2 - 5000 AS start, (start + "end") // 2 + 5000 AS "end" FROM (SELECT chrom, start, "end" FROM regions ORDER BY md5(concat(chrom, '|', start, '|', "end", '|42')), chrom, start, "end" LIMIT 500)),
  per AS (SELECT r.chrom, r.start, r."end", t.track, abs(sum(t.value * (least(r."end", t."end") - greatest(r.start, t.start)))) AS part FROM (SELECT DISTINCT * FROM s) r JOIN tracks t ON r.chrom = t.chrom AND r.start < t."end" AND t.start < r."end" GROUP BY ALL),
  total AS (SELECT chrom, start, "end", sum(part) AS signal FROM per GROUP BY ALL) SELECT round(quantile_cont(coalesce(signal, 0), 0.9), 4) AS threshold FROM s LEFT JOIN total USING (chrom, start, "end")""")
def a2_noise_threshold(spark, sf):
    tracks = view(spark, sf, "tracks").select("chrom", "start", "end", "value", "track")
    return rounded(training.noise_threshold(view(spark, sf, "regions").select("chrom", "start", "end"), tracks, 10_000, 90.0, 500), "threshold", digits=4)


# Signal of the regions of a CTE {of}, resized to {length} around their centres.
RESIZED_SQL = """{to}_w AS (SELECT *, (start + "end") // 2 - {half} AS ws, (start + "end") // 2 + {half} AS we FROM {of}),
  {to}_p AS (SELECT r.chrom, r.ws, r.we, t.track, abs(sum(t.value * (least(r.we, t."end") - greatest(r.ws, t.start)))) AS part
    FROM (SELECT DISTINCT chrom, ws, we FROM {to}_w) r JOIN tracks t ON r.chrom = t.chrom AND r.ws < t."end" AND t.start < r.we GROUP BY ALL),
  {to}_s AS (SELECT chrom, ws, we, sum(part) AS signal FROM {to}_p GROUP BY ALL), {to} AS (SELECT w.*, coalesce(signal, 0) AS signal FROM {to}_w w LEFT JOIN {to}_s USING (chrom, ws, we))"""
_HASH = """md5(concat(chrom, '|', start, '|', "end", '|42')), chrom, start, "end\""""


@query(f"""{with_views('regions', 'tracks')}, background AS (SELECT chrom, start, "end" FROM regions WHERE event_id % 2 = 0 ORDER BY {_HASH} LIMIT 400),
  promoters AS (SELECT chrom, start, "end", concat('TF', event_id % 50) AS name FROM regions), {RESIZED_SQL.format(of='background', to='noise', half=5000)}, {RESIZED_SQL.format(of='promoters', to='measured', half=5000)}
  SELECT DISTINCT name FROM measured WHERE signal > (SELECT quantile_cont(signal, 0.95) FROM noise)""")
def c6_a26_expressed(spark, sf):
    """Names of regions with more signal than the noise threshold of sampled regions."""
    regions = view(spark, sf, "regions")
    tracks = view(spark, sf, "tracks").select("chrom", "start", "end", "value", "track")
    promoters = regions.select("chrom", "start", "end", F.concat(F.lit("TF"), (F.col("event_id") % 50).cast("string")).alias("name"))
    background = regions.where("event_id % 2 = 0").select("chrom", "start", "end")
    return training.get_expressed_tfs(promoters, background, tracks, 10_000, 95.0, 400)


# ---- rank statistics -----------------------------------------------------------

GROUPS = "g AS (SELECT p_brand AS name, l_discount * l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey), z AS (SELECT l_discount * l_quantity AS value FROM lineitem WHERE l_quantity > 20 AND l_quantity <= 35)"
RANKS = """zc AS (SELECT value AS v, count(*) AS zc FROM z GROUP BY 1), gc AS (SELECT name, value AS v, count(*) AS gc FROM g GROUP BY 1, 2),
  vals AS (SELECT v, coalesce(zc, 0) AS zc FROM (SELECT v FROM zc UNION SELECT v FROM gc) LEFT JOIN zc USING (v)), le0 AS (SELECT v, zc, sum(zc) OVER (ORDER BY v) AS le0 FROM vals),
  tot AS (SELECT sum(zc)::DOUBLE AS n0, sum(zc::DOUBLE ** 3 - zc) AS ties0 FROM zc), own AS (SELECT name, v, gc, sum(gc) OVER (PARTITION BY name ORDER BY v) AS le, sum(gc) OVER (PARTITION BY name)::DOUBLE AS n FROM gc),
  stats AS (SELECT name, n, n0, max(greatest(abs(le / n - le0 / n0), abs((le - gc) / n - (le0 - zc) / n0))) AS ks_d, sum(gc * (le0 - zc / 2)) AS mw_u,
    ties0 + sum((gc + zc)::DOUBLE ** 3 - (gc + zc) - (zc::DOUBLE ** 3 - zc)) AS tie_sum FROM own JOIN le0 USING (v) CROSS JOIN tot GROUP BY name, n, n0, ties0)"""
KS_P = "CASE WHEN ks_d * ks_d * (n * n0 / (n + n0)) < 0.02 THEN 1 ELSE greatest(0, least(1, list_sum([CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * ks_d * ks_d * (n * n0 / (n + n0))) FOR k IN range(1, 101)]))) END"
MW_Z = "CASE WHEN n * n0 / 12 * ((n + n0 + 1) - tie_sum / ((n + n0) * (n + n0 - 1))) > 0 THEN greatest(abs(mw_u - n * n0 / 2) - 0.5, 0) / sqrt(n * n0 / 12 * ((n + n0 + 1) - tie_sum / ((n + n0) * (n + n0 - 1)))) ELSE 0 END"

# Two-sided normal p: 1 - erf(z / sqrt(2)) by the series of positive terms.
MW_P = "CASE WHEN mw_z > 0 THEN greatest(0, 1 - 2 / sqrt(pi()) * exp(-mw_z * mw_z / 2) * list_sum([exp((2 * k + 1) * ln(mw_z / sqrt(2)) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)) FOR k IN range(0, 400)])) ELSE 1 END"
# Two-sided Student p with n - 2 degrees: 1 less the density between -t and t, by Simpson's rule in atan(t / sqrt(n - 2)).
STUDENT_P = """1 - 2 * exp(lgamma((n - 1) / 2::DOUBLE) - lgamma((n - 2) / 2::DOUBLE)) / sqrt(pi()) * (atan(abs(t) / sqrt(n - 2)) / 2000) / 3
    * list_sum([CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(k * atan(abs(t) / sqrt(n - 2)) / 2000), n - 3) FOR k IN range(0, 2001)])"""


def _samples(spark, sf):
    line = view(spark, sf, "lineitem").withColumn("value", F.col("l_discount") * F.col("l_quantity"))
    g = line.join(view(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), "value")
    return g, line.where("l_quantity > 20 and l_quantity <= 35").select("value")


@query(f"WITH {GROUPS}, {RANKS} SELECT name, n::BIGINT AS n, n0::BIGINT AS n0, round(ks_d, 9) AS ks_d, mw_u, tie_sum, round({KS_P}, 6) AS ks_p, round({MW_Z}, 6) AS mw_z FROM stats")
def a7_a8_rank_pass(spark, sf):
    out = rankstats.with_p_values(rankstats.rank_pass(*_samples(spark, sf)), "asymptotic")
    return rounded(rounded(out, "ks_d", digits=9), "ks_p", "mw_z").select("name", "n", "n0", "ks_d", "mw_u", "tie_sum", "ks_p", "mw_z")


@query(f"""WITH {GROUPS.split(', z AS')[0]}, z AS (SELECT value FROM g), {RANKS}, med AS (SELECT name, quantile_cont(value, 0.5) AS own, count(*) AS c FROM g GROUP BY name)
  SELECT name, CASE WHEN c >= 200 THEN round(CASE WHEN own < (SELECT quantile_cont(value, 0.5) FROM g) THEN -ks_d ELSE ks_d END, 6) END AS ks FROM stats JOIN med USING (name)""")
def a6_signed_ks(spark, sf):
    return rounded(rankstats.signed_ks(_samples(spark, sf)[0], "name", "value", 200), "ks")


@query(f"""{with_views('coop')}, o AS (SELECT *, row_number() OVER (ORDER BY ks_p, tf_pair) AS r, count(*) OVER () AS m FROM coop)
  SELECT tf_pair, round(least(1, min(ks_p * m / r) OVER (ORDER BY r DESC)), 9) AS q FROM o""")
def a11_w4_bh(spark, sf):
    return rounded(rankstats.benjamini_hochberg(view(spark, sf, "coop").select("tf_pair", "ks_p"), "ks_p", "q", "tf_pair"), "q", digits=9).select("tf_pair", "q")


@query(f"""{with_views('coop')}, lim AS (SELECT quantile_cont(coop_score, 0.3) AS lo, quantile_cont(coop_score, 0.7) AS hi FROM coop WHERE ks_q < 0.04)
  SELECT tf_pair, CASE WHEN ks_q < 0.04 THEN CASE WHEN coop_score > hi THEN 'Synergistic' WHEN coop_score < lo THEN 'Redundant' ELSE 'Intermediate' END ELSE 'Independent' END AS cooperativity FROM coop CROSS JOIN lim""")
def a12_classes(spark, sf):
    from coopspark.operators.coop import assign_classes

    return assign_classes(view(spark, sf, "coop").drop("cooperativity"), 0.04).select("tf_pair", "cooperativity")


def _adjacent_sql(a, b, view_name, value):
    ranks = RANKS.replace("FROM z ", "FROM z_ ").replace("FROM g ", "FROM g_ ")
    return f"(WITH g_ AS (SELECT '{a}' AS name, {value} AS value FROM {view_name} WHERE cooperativity = '{a}'), z_ AS (SELECT {value} AS value FROM {view_name} WHERE cooperativity = '{b}'), {ranks} SELECT name AS a, '{b}' AS b, n::BIGINT AS n_a, n0::BIGINT AS n_b, mw_u, round({MW_Z}, 6) AS mw_z FROM stats WHERE n > 1 AND n0 > 1)"


@query(f"{with_views('coop')} SELECT * FROM (" + " UNION ALL ".join(_adjacent_sql(a, b, "coop", "mean_distance") for a, b in (("Independent", "Redundant"), ("Redundant", "Intermediate"), ("Intermediate", "Synergistic"))) + ")")
def a13_r7_adjacent(spark, sf):
    from coopspark.schemas import CATEGORIES

    return rounded(rankstats.adjacent_tests(view(spark, sf, "coop"), "cooperativity", "mean_distance", CATEGORIES), "mw_z").select("a", "b", "n_a", "n_b", "mw_u", "mw_z")


@query(f"""{with_views('tfs')} , c AS (SELECT cooperativity = 'Independent' AS independent, count(*) AS n, CASE WHEN count(*) > 2 THEN corr(coop_score, mean_isa_t0) END AS r,
  CASE WHEN count(*) > 2 THEN corr(coop_score, mean_isa_t0) * sqrt((count(*) - 2) / (1 - corr(coop_score, mean_isa_t0) ** 2)) END AS t FROM tfs GROUP BY 1)
  SELECT independent, n, round(r, 6) AS r, round(t, 6) AS t, CASE WHEN n > 2 THEN round({STUDENT_P}, 6) END AS p FROM c""")
def a16_r9_pearson(spark, sf):
    own = view(spark, sf, "tfs").withColumn("independent", F.col("cooperativity") == "Independent")
    return rounded(rankstats.pearson(own, "coop_score", "mean_isa_t0", ["independent"]), "r", "t", "p")


# ---- report tables -------------------------------------------------------------


@query("""WITH v AS (SELECT l_shipdate, l_linenumber AS distance, l_discount - 0.05 AS interaction_t0, l_tax - 0.04 AS interaction_t1 FROM lineitem),
  l AS (SELECT 'interaction_t0' AS track, distance, interaction_t0 AS value FROM v UNION ALL SELECT 'interaction_t1', distance, interaction_t1 FROM v)
  SELECT track, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sign, distance, round(avg(value), 6) AS mean FROM l WHERE value <> 0 GROUP BY ALL
  UNION ALL SELECT track, 'absolute', distance, round(avg(abs(value)), 6) FROM l GROUP BY ALL""")
def a14_r3_decay(spark, sf):
    v = view(spark, sf, "lineitem").select(F.col("l_linenumber").alias("distance"), (F.col("l_discount") - 0.05).alias("interaction_t0"), (F.col("l_tax") - 0.04).alias("interaction_t1"))
    return rounded(report.decay(v, [0, 1]).unionByName(report.decay(v, [0, 1], "absolute")), "mean")


@query(f"""{with_views('coop')}, c AS (SELECT substr(tf1, 1, 6) || ' ' AS a, coop_score FROM coop WHERE cooperativity <> 'Independent') SELECT 'Brand' AS prefix1, 'Brand' AS prefix2, round(avg(coop_score), 6) AS mean FROM c""")
def r5_heatmap_brand(spark, sf):
    return rounded(report.prefix_matrix(view(spark, sf, "coop")), "mean")


@query("""WITH pairs AS (SELECT regexp_extract(p_name, '^([a-zA-Z]+)', 1) AS prefix1, p_type AS prefix2, avg(p_retailprice) AS m FROM part GROUP BY ALL)
  SELECT prefix1, round(max(m) FILTER (prefix2 = 'ECONOMY'), 4) AS "ECONOMY", round(max(m) FILTER (prefix2 = 'PROMO'), 4) AS "PROMO" FROM pairs GROUP BY prefix1""")
def a15_r5_matrix(spark, sf):
    own = view(spark, sf, "part").select(F.concat("p_name", F.lit("|"), "p_type").alias("tf_pair"), F.col("p_retailprice").alias("coop_score"), F.lit("Synergistic").alias("cooperativity"))
    return rounded(report.prefix_matrix(own, prefixes=["ECONOMY", "PROMO"]), "ECONOMY", "PROMO", digits=4)


@query(f"""{with_views('coop')}, b AS (SELECT *, min(coop_score) OVER () AS lo, max(coop_score) OVER () AS hi FROM coop WHERE cooperativity <> 'Independent')
  SELECT cooperativity, least(floor((coop_score - lo) / nullif(hi - lo, 0) * 50), 49)::INT AS bin, count(*) AS n FROM b GROUP BY ALL""")
def a19_r4_histogram(spark, sf):
    return report.histogram(report.not_independent(view(spark, sf, "coop")), "coop_score", 50, ["cooperativity"])


BOX = """SELECT {g}, q.n, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(min({v}) FILTER ({v} >= q1 - 1.5::DOUBLE * (q3 - q1) AND {v} <= q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS low,
  round(max({v}) FILTER ({v} >= q1 - 1.5::DOUBLE * (q3 - q1) AND {v} <= q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS high, count(*) FILTER (NOT ({v} >= q1 - 1.5::DOUBLE * (q3 - q1) AND {v} <= q3 + 1.5::DOUBLE * (q3 - q1))) AS outliers
  FROM {t} JOIN (SELECT {g}, count(*) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM {t} GROUP BY {g}) q USING ({g}) GROUP BY {g}, q.n, q1, q2, q3"""


@query(f"{with_views('coop')} {BOX.format(g='cooperativity', v='mean_distance', t='coop')}")
def a17_r19_box(spark, sf):
    return rounded(report.box_stats(view(spark, sf, "coop"), "mean_distance", ["cooperativity"]), "q1", "median", "q3", "low", "high")


@query(f"""WITH e AS (SELECT event_type, value FROM events) SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS ecdf, round(median(value) OVER (PARTITION BY event_type), 6) AS median FROM e""")
def a18_w6_ecdf(spark, sf):
    return rounded(rounded(report.ecdf(view(spark, sf, "events"), "value", "event_type"), "ecdf", digits=9), "median")


@query("""WITH v AS (SELECT l_returnflag, l_discount * 10 - 0.5 AS x FROM lineitem), c AS (SELECT l_returnflag, floor((x + 1) / 0.001::DOUBLE) AS cell, count(*) AS c FROM v GROUP BY ALL),
  s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(x) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM v GROUP BY 1), grid AS (SELECT -1::DOUBLE + i * (2::DOUBLE / 199) AS x FROM range(200) t(i))
  SELECT l_returnflag, round(x, 9) AS x, round(sum(c * exp(-0.5::DOUBLE * ((x - (-1 + (cell + 0.5) * 0.001::DOUBLE)) / h) ** 2) / (n * h * 2.5066282746310002::DOUBLE)), 6) AS density FROM c JOIN s USING (l_returnflag) CROSS JOIN grid GROUP BY l_returnflag, x""")
def a20_r1_density(spark, sf):
    v = view(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 10 - 0.5).alias("v"))
    return rounded(report.density(v, "v", 200, ["l_returnflag"]), "density").withColumn("x", F.round("x", 9))


@query(f"""{with_views('coop')}, m AS (SELECT tf1 AS tf, tf2 AS partner, abs_i_sum AS v FROM coop UNION ALL SELECT tf2, tf1, abs_i_sum FROM coop), r AS (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY v DESC, partner) AS p FROM m)
  SELECT tf, round(sum(v) FILTER (p <= 5) / sum(v), 6) AS specificity_ratio FROM r GROUP BY tf HAVING count(*) >= 10""")
def a22_r10_top_share(spark, sf):
    return rounded(report.top_share(view(spark, sf, "coop")), "specificity_ratio")


@query(f"""{with_views('coop')}, m AS (SELECT tf1 AS tf, tf2 AS partner, abs_i_sum AS v FROM coop UNION ALL SELECT tf2, tf1, abs_i_sum FROM coop), r AS (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY v DESC, partner) AS p FROM m),
  s AS (SELECT tf, sum(v) FILTER (p <= 5) / sum(v) AS ratio FROM r GROUP BY tf HAVING count(*) >= 10),
  c AS (SELECT p_brand AS tf, CASE WHEN avg(p_size) > 26 THEN 'Synergistic' WHEN avg(p_size) < 25 THEN 'Redundant' ELSE 'Independent' END AS cooperativity FROM part GROUP BY 1),
  j AS (SELECT tf, cooperativity, ratio FROM s JOIN c USING (tf) WHERE cooperativity <> 'Independent'), b AS (SELECT *, min(ratio) OVER () AS lo, max(ratio) OVER () AS hi FROM j)
  SELECT cooperativity, CASE WHEN hi > lo THEN least(floor((ratio - lo) / nullif(hi - lo, 0) * 10), 9) ELSE 0 END::INT AS bin, count(*) AS n FROM b WHERE ratio IS NOT NULL GROUP BY ALL""")
def r10_specificity_by_class(spark, sf):
    """How the shares of the strongest partners are spread in each class."""
    size = F.avg("p_size")
    kind = F.when(size > 26, "Synergistic").when(size < 25, "Redundant").otherwise("Independent")
    tfs = view(spark, sf, "part").groupBy(F.col("p_brand").alias("tf")).agg(kind.alias("cooperativity"))
    own = report.specificity_by_class(view(spark, sf, "coop"), tfs)
    return report.histogram(own, "specificity_ratio", 10, ["cooperativity"])


@query(f"""{with_views('coop')}, {_KNOWN}, f AS (SELECT tf_pair, ks_p, CASE WHEN tf_pair IN (SELECT pair FROM known) THEN 1 ELSE 0 END AS is_ppi FROM coop)
  SELECT tf_pair, row_number() OVER w AS place, round(row_number() OVER w * 100.0::DOUBLE / count(*) OVER (), 6) AS pct_total_pairs, round(sum(is_ppi) OVER w * 100.0::DOUBLE / sum(is_ppi) OVER (), 6) AS pct_ppi_found FROM f
  WINDOW w AS (ORDER BY ks_p, tf_pair ROWS UNBOUNDED PRECEDING)""")
def a23_r16_enrichment(spark, sf):
    flagged = annotate.known_pairs(view(spark, sf, "coop"), known_reference(spark, sf))
    return rounded(report.enrichment_curve(flagged), "pct_total_pairs", "pct_ppi_found").select("tf_pair", "place", "pct_total_pairs", "pct_ppi_found")


@query(f"""{with_views('tfs')}, c AS (SELECT quantile_cont(gini, 0.75) AS hi, quantile_cont(gini, 0.25) AS lo FROM tfs), f AS (SELECT tf || family AS tf, coop_score, (gini >= hi)::INT AS is_specific, (gini <= lo)::INT AS is_ubiquitous FROM tfs CROSS JOIN c)
  SELECT tf, is_specific, is_ubiquitous, CASE WHEN count(*) OVER w = 20 THEN round(avg(is_specific) OVER w, 6) END AS rolling_spec, CASE WHEN count(*) OVER w = 20 THEN round(avg(is_ubiquitous) OVER w, 6) END AS rolling_ubiq FROM f
  WINDOW w AS (ORDER BY coop_score, tf ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""")
def a25_w1_r15_specificity(spark, sf):
    own = view(spark, sf, "tfs").withColumn("tf", F.concat("tf", "family"))
    return rounded(report.specificity_trend(own, 20), "rolling_spec", "rolling_ubiq").select("tf", "is_specific", "is_ubiquitous", "rolling_spec", "rolling_ubiq")


@query(f"""WITH {GROUPS} SELECT name, round(quantile_cont(value, 0.5) - (SELECT quantile_cont(value, 0.5) FROM z), 6) AS shift FROM g GROUP BY name""")
def a27_median_shift(spark, sf):
    g, z = _samples(spark, sf)
    null = quantiles(z, "value", {"null": 0.5})  # one row
    own = quantiles(g, "value", {"own": 0.5}, ["name"])
    return rounded(own.crossJoin(F.broadcast(null)).select("name", (F.col("own") - F.col("null")).alias("shift")), "shift")


@query("""WITH p AS (SELECT lang AS split, ln(1 + n_chars) AS p_reg, quality + n_chars / 10000::DOUBLE AS y_reg, n_chars / 1000::DOUBLE - 1 AS z, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id))
  SELECT split, count(*) AS n, round(avg(pow(p_reg - y_reg, 2)), 6) AS mse, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(pow(p_reg - y_reg, 2)) + avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss,
  round(corr(p_reg, y_reg), 6) AS pearson, round(avg(CASE WHEN (z > 0) = (y > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY split HAVING count(*) > 2""")
def a28_m6_metrics(spark, sf):
    own = view(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(view(spark, sf, "labels"), "doc_id")
    p = own.select(F.col("lang").alias("split"), F.log1p("n_chars").alias("p_reg"), (F.col("quality") + F.col("n_chars") / 10000).alias("y_reg"), (F.col("n_chars") / 1000 - 1).alias("z_class"), F.col("quality").cast("double").alias("y_class"))
    return rounded(training.metrics(p, ["split"]), "mse", "bce", "loss", "pearson", "accuracy").where("n > 2")


@query(f"""{with_views('coop')}, {_MATRIX}, c AS (SELECT coop_score, coalesce(a.p300, 0) + coalesce(b.p300, 0) AS p300, coalesce(a.med, 0) + coalesce(b.med, 0) AS med FROM coop LEFT JOIN matrix a ON a.tf = tf1 LEFT JOIN matrix b ON b.tf = tf2),
  l AS (SELECT 'p300' AS cofactor, p300 AS recruiters, coop_score FROM c UNION ALL SELECT 'med', med, coop_score FROM c), k AS (SELECT cofactor FROM l GROUP BY cofactor HAVING count(DISTINCT recruiters) > 1)
  SELECT cofactor, recruiters, count(*) AS n, round(quantile_cont(coop_score, 0.5), 6) AS median FROM l JOIN k USING (cofactor) GROUP BY ALL""")
def a29_r17_recruitment(spark, sf):
    own = report.cofactor_recruitment(view(spark, sf, "coop"), cofactor_matrix(spark, sf), ["p300", "med"])
    return rounded(own, "median").select("cofactor", "recruiters", "n", "median")


@query("""WITH o AS (SELECT p_partkey, p_name, CASE WHEN regexp_extract(p_name, '^([a-zA-Z]+)', 1) <> '' THEN regexp_extract(p_name, '^([a-zA-Z]+)', 1) ELSE p_name END AS prefix FROM part),
  c AS (SELECT *, CASE WHEN prefix = lag(prefix) OVER (ORDER BY p_partkey) THEN 0 ELSE 1 END AS new FROM o), r AS (SELECT *, sum(new) OVER (ORDER BY p_partkey) AS run FROM c)
  SELECT p_partkey, p_name, CASE WHEN count(*) OVER (PARTITION BY run) = 1 THEN p_name WHEN new = 1 THEN prefix || 's' ELSE '' END AS label FROM r""")
def w3_r6_labels(spark, sf):
    return report.compressed_labels(view(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("""WITH t AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3) SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM t)""")
def f17_t2_most_frequent(spark, sf):
    return report.most_frequent(view(spark, sf, "part"), "p_type", 3).select("p_partkey", "p_type")


@query(f"""{with_views('tfs')}, d AS (SELECT * FROM tfs WHERE coop_score IS NOT NULL), t AS (SELECT family FROM d GROUP BY family ORDER BY count(*) DESC, family LIMIT 4), k AS (SELECT * FROM d WHERE family IN (SELECT family FROM t))
  {BOX.format(g='family', v='coop_score', t='k')}""")
def r12_by_family(spark, sf):
    own = report.most_frequent(view(spark, sf, "tfs").dropna(subset=["coop_score"]), "family", 4)
    return rounded(report.box_stats(own, "coop_score", ["family"]), "q1", "median", "q3", "low", "high")


_FAMILY_SQL = "f AS (SELECT p_brand AS symbol, arg_min(p_type, p_partkey) AS family FROM part WHERE p_size > 20 GROUP BY 1), p AS (SELECT coop.*, a.family AS family1, coalesce(a.family = b.family, false) AS same FROM coop LEFT JOIN f a ON a.symbol = tf1 LEFT JOIN f b ON b.symbol = tf2)"


def _with_family(spark, sf):
    f = view(spark, sf, "part").where("p_size > 20").groupBy(F.col("p_brand").alias("symbol")).agg(F.min_by("p_type", "p_partkey").alias("family"))
    return annotate.annotate_family(view(spark, sf, "coop").dropna(subset=["coop_score"]), f)


@query(f"""{with_views('coop')}, {_FAMILY_SQL}, g AS (SELECT 'same' AS name, coop_score AS value FROM p WHERE same), z AS (SELECT coop_score AS value FROM p WHERE NOT same), {RANKS}
  SELECT n::BIGINT AS n, n0::BIGINT AS n0, mw_u, round({MW_Z}, 6) AS mw_z FROM stats""")
def r11_same_family(spark, sf):
    own = _with_family(spark, sf)
    same = own.where("same_family").select(F.lit("same").alias("name"), F.col("coop_score").alias("value"))
    stats = rankstats.with_p_values(rankstats.rank_pass(same, own.where("not same_family").select(F.col("coop_score").alias("value"))))
    return rounded(stats, "mw_z").select("n", "n0", "mw_u", "mw_z")


@query(f"{with_views('coop')}, {_FAMILY_SQL} SELECT family1, count(*) AS n, round(quantile_cont(coop_score, 0.5), 6) AS median FROM p WHERE same GROUP BY family1 HAVING count(*) >= 3")
def r13_intra_family(spark, sf):
    own = report.box_stats(_with_family(spark, sf).where("same_family"), "coop_score", ["family1"]).where("n >= 3")
    return rounded(own, "median").select("family1", "n", "median")


@query("""WITH u AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size <= 5), e AS (SELECT CASE WHEN p_brand IN (SELECT name FROM u) THEN 'listed' ELSE 'other' END AS kind, p_retailprice AS value FROM part)
  SELECT DISTINCT kind, value, round(cume_dist() OVER (PARTITION BY kind ORDER BY value), 9) AS ecdf, round(median(value) OVER (PARTITION BY kind), 6) AS median FROM e""")
def r14_listed_ecdf(spark, sf):
    part = view(spark, sf, "part").select(F.col("p_brand").alias("tf"), F.col("p_retailprice").alias("value"))
    names = view(spark, sf, "part").where("p_size <= 5").select(F.col("p_brand").alias("name")).distinct()
    listed = annotate.is_listed(part, names, "tf").select(F.lit("listed").alias("kind"), "value")
    other = part.join(names, F.col("tf") == F.col("name"), "left_anti").select(F.lit("other").alias("kind"), "value")
    return rounded(rounded(report.ecdf(listed.unionByName(other), "value", "kind"), "ecdf", digits=9), "median")


@query(f"""{with_views('coop')}, m AS (SELECT concat(least(a.p_brand, b.p_brand), '|', greatest(a.p_brand, b.p_brand)) AS tf_pair, max(CASE WHEN a.p_size > 45 THEN 1 ELSE 0 END) AS binds FROM part a JOIN part b ON a.p_partkey + 3 = b.p_partkey GROUP BY 1)
  SELECT binds, count(*) AS n, round(quantile_cont(-log10(CASE WHEN ks_p = 0 THEN 1e-300 ELSE ks_p END), 0.5), 6) AS median FROM coop JOIN m USING (tf_pair) GROUP BY binds""")
def r18_j8_mediated(spark, sf):
    a, b = view(spark, sf, "part").alias("a"), view(spark, sf, "part").alias("b")
    m = a.join(b, F.col("a.p_partkey") + 3 == F.col("b.p_partkey")).select(S.canonical_pair(F.col("a.p_brand"), F.col("b.p_brand")).alias("tf_pair"), (F.col("a.p_size") > 45).cast("int").alias("flag")).groupBy("tf_pair").agg(F.max("flag").alias("binds"))
    own = view(spark, sf, "coop").join(m, "tf_pair").withColumn("value", S.minus_log10(F.col("ks_p")))
    return rounded(report.box_stats(own, "value", ["binds"]), "median").select("binds", "n", "median")


@query(f"""{with_views('tfs')}, g AS (SELECT p_brand AS tf, round(avg(p_size), 12) AS gc FROM part GROUP BY 1), j AS (SELECT cooperativity, gc FROM tfs JOIN g USING (tf))
  SELECT cooperativity, count(*) AS n, round(quantile_cont(gc, 0.5), 6) AS median FROM j GROUP BY 1""")
def r8_gc_by_class(spark, sf):
    g = view(spark, sf, "part").groupBy(F.col("p_brand").alias("tf")).agg(F.round(F.avg("p_size"), 12).alias("gc"))
    return rounded(report.box_stats(view(spark, sf, "tfs").join(g, "tf"), "gc", ["cooperativity"]), "median").select("cooperativity", "n", "median")
