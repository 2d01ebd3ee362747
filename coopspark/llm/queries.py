"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coopspark.llm import ann, bpe, decontaminate, hardneg, minhash, mixing, quality, sharding, tokenbin, topk, toxicity, urlfilter, whitening

#: Fixed values of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one by integer inner product."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP2_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as byte planes in doc_id order, read back and digested."""
    files = tokenbin.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.ids_crc32(files)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixing.sample(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2 * source_size AS cap FROM per),
shares AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN cap::DOUBLE
              ELSE first_value(level) OVER (ORDER BY level * weight >= cap, cap / weight, source NULLS LAST) * weight END AS target
  FROM shares),
rests AS (
  SELECT *, greatest(target - whole * source_size, 0) AS rest, CASE WHEN source_size > 0 AND whole < 2 THEN greatest(target - whole * source_size, 0) / source_size ELSE 0 END AS fraction
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM targets)),
counts AS (
  SELECT r.source, r.rest, d.size, count(*) AS n FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source WHERE d.size > 0 AND r.fraction > 0 GROUP BY ALL),
summed AS (
  SELECT *, coalesce(sum(size * n) OVER below, 0)::BIGINT AS words, (sum(n) OVER (PARTITION BY source) - coalesce(sum(n) OVER below, 0))::BIGINT AS others
  FROM counts WINDOW below AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT source, min(size) AS since, arg_min((rest - words::DOUBLE) / others::DOUBLE, size) AS level FROM summed WHERE words + size * others >= rest GROUP BY source),
s0 AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest AS missing, false AS taken,
         CASE WHEN d.size = 0 THEN NULL WHEN d.size < l.since THEN -1 WHEN l.level > 0 THEN u / (1 - u) * ((d.size::DOUBLE - l.level) / l.level) END AS q
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN levels l ON d.source IS NOT DISTINCT FROM l.source),
r0 AS (SELECT *, row_number() OVER (PARTITION BY source, q) AS nth FROM s0),
p0 AS (
  SELECT *, CASE WHEN q > cut AND size <= missing THEN sum(CASE WHEN q > cut AND size <= missing THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, nth) END AS words
  FROM (SELECT *, coalesce(max(CASE WHEN taken THEN q END) OVER (PARTITION BY source), -2) AS cut FROM r0)),
s1 AS (
  SELECT doc_id, source, size, u, source_size, target, whole, q, nth, taken OR coalesce(words <= missing, false) AS taken,
         missing - coalesce(max(CASE WHEN words <= missing THEN words END) OVER (PARTITION BY source), 0) AS missing FROM p0),
p1 AS (
  SELECT *, CASE WHEN q > cut AND size <= missing THEN sum(CASE WHEN q > cut AND size <= missing THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, nth) END AS words
  FROM (SELECT *, coalesce(max(CASE WHEN taken THEN q END) OVER (PARTITION BY source), -2) AS cut FROM s1)),
s2 AS (
  SELECT doc_id, source, size, u, source_size, target, whole, q, nth, taken OR coalesce(words <= missing, false) AS taken,
         missing - coalesce(max(CASE WHEN words <= missing THEN words END) OVER (PARTITION BY source), 0) AS missing FROM p1),
p2 AS (
  SELECT *, CASE WHEN q > cut AND size <= missing THEN sum(CASE WHEN q > cut AND size <= missing THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, nth) END AS words
  FROM (SELECT *, coalesce(max(CASE WHEN taken THEN q END) OVER (PARTITION BY source), -2) AS cut FROM s2)),
s3 AS (
  SELECT doc_id, source, size, u, source_size, target, whole, q, nth, taken OR coalesce(words <= missing, false) AS taken,
         missing - coalesce(max(CASE WHEN words <= missing THEN words END) OVER (PARTITION BY source), 0) AS missing FROM p2),
last AS (
  SELECT source, arg_min(struct_pack(q := q, nth := nth), struct_pack(a := abs(size - missing), b := q, c := nth)) AS last FROM s3 WHERE q IS NOT NULL AND NOT taken AND abs(size - missing) < missing GROUP BY source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN taken OR coalesce(q = last.last.q AND nth = last.last.nth, false) THEN 1 ELSE 0 END) AS taken
FROM s3 LEFT JOIN last ON s3.source IS NOT DISTINCT FROM last.source
"""


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near neighbours of every hundredth vector, found in an NN-descent graph."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, urlfilter.RULES)
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM best
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(encoded)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM patterns),
places AS (SELECT row, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT p.row, p.k, p.i, q.item FROM places p JOIN patterns q ON p.k = q.k AND p.win = q.win),
hits AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT row, i, k FROM found)) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, where every seventh row's label is off by one."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
           FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
mined AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
          FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM mined WHERE rank <= 3
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading whitened components of all vectors."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES = (op1_minhash, op2_topk, op3_toxicity, op4_quality, op5_token_ids, op6_mixing, op7_ann, op8_url_filter, op9_sharding, op10_byte_bpe, op11_decontamination, op12_hard_negatives, op13_whitening)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op6_mixing": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL}
