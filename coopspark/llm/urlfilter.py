"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict. It fits a url whose host is the rule's
or below it and whose path starts with the rule's path. The longest expression
wins; of equally long ones the longer host, then ``block``.

Each url is expanded into expressions ``host-suffix + path-prefix``, but only of
the *shapes* (number of host labels, path length) that some rule has, so the
expansion doesn't grow with the number of rules and a path prefix need not end
at a slash. Expressions meet rules in an equi-join on the first
``prefix_hex`` hex digits of their SHA-256; the full digests then confirm.
Rules are broadcast if their counted rows allow it; otherwise they are copied
once for each salt and the join is shuffled, so that a host with a third of all
urls is spread over the salts.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; no rule leaves ``rule`` null and gives the default verdict;
repeated rows are judged repeatedly; extra columns are not looked at; null
page_ids are kept; without rules everything gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of
from coopspark.plans.stage import BROADCAST_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"
SALTS = 16


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to a table with a column ``url``."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_hex: int = 8, id_col: str = "page_id", url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    own = columns_of(pages, id_col, url_col).select(F.col(id_col).alias("id__"), F.col(url_col).alias("url"))
    # Rows with the same id and url get the same verdict: judged once, then repeated.
    distinct = host_and_path(own.groupBy("id__", "url").agg(F.count(F.lit(1)).alias("times")))
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host is not null")
    listed = listed.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256)).withColumn("key", F.substring("digest", 1, prefix_hex))
    shapes = listed.select(F.struct(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).alias("shape")).distinct()
    shapes = shapes.agg(F.sort_array(F.collect_set("shape")).alias("shapes"))  # one row, as many entries as rules have shapes

    labels = F.split("host", r"\.")
    fits = F.filter("shapes", lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length("path")))
    expression = F.transform(fits, lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."), F.substr("path", F.lit(1), s["chars"])))
    expanded = distinct.join(F.broadcast(shapes)).withColumn("expressions", F.when(F.col("host") != "", expression))
    tried = expanded.select("id__", "url", "host", "path", "times", F.explode_outer(F.array_distinct("expressions")).alias("expression")).withColumn("tried", F.sha2("expression", 256))
    tried = tried.withColumn("near", F.substring("tried", 1, prefix_hex))

    if listed.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = tried.join(F.broadcast(listed), F.col("near") == F.col("key"), "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tried = tried.withColumn("at", F.pmod(F.hash("id__", "url"), F.lit(SALTS)))
        joined = tried.join(salted, (F.col("near") == F.col("key")) & (F.col("at") == F.col("salt")), "left")
    # The prefix only selects candidates; the full digest confirms them.
    best = F.max(F.when(F.col("tried") == F.col("digest"), F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), F.col("rule"), F.col("rule_verdict")))).alias("best")
    judged = joined.groupBy("id__", "url", "host", "path", "times").agg(best)
    repeated = judged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select(F.col("id__").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
