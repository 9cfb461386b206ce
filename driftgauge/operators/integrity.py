"""Integrity of coverage manifests as frames: what contradicts what, by joins on keys.

entries (source, source_key, disposition, rules array<string>, note), keys (source, source_key) that a source has, rules (rule_id). Each
violation is a row (source, source_key, rule_id, problem); what does not apply is null. Entries and keys may be of any size;
rules are as many as a registry holds, which its loader bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import match as M
from driftgauge.sources import schema

#: Entries and keys that one task groups, so that what it holds does not follow from their number or from the session's settings.
TASK_ROWS = 250_000
VIOLATION = ["source", "source_key", "rule_id", "problem"]


def row(df: DataFrame, problem: str, source: str | None = "source", key: str | None = "source_key", rule: str | None = None) -> DataFrame:
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return df.select(text(source).alias("source"), text(key).alias("source_key"), text(rule).alias("rule_id"), F.lit(problem).alias("problem"))


def violations(entries: DataFrame, keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys without an entry and entries without a key, entries that repeat, rules that are unknown, repeated or missing where the
    disposition asks for them or present where it forbids them, notes that are missing, and rules that nothing covers."""
    both = ["source", "source_key"]
    backed = F.col("disposition").isin(list(schema.RULE_BACKED))
    some = F.size(F.coalesce("rules", F.array().cast("array<string>"))) > 0
    some_named = M.spread(entries.where(some).select(*both, "rules"), key=both, most=TASK_ROWS)
    counted = some_named.select(*both, F.explode("rules").alias("rule_id")).groupBy(*both, "rule_id").agg(F.count("*").alias("n"))
    counted = counted.join(F.broadcast(rules.select("rule_id").distinct().withColumn("known", F.lit(True))), "rule_id", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    met = entries.select(*both, one.alias("entry"), none.alias("key")).union(keys.select(*both, none, one))
    met = M.spread(met, key=both, most=TASK_ROWS).groupBy(*both).agg(F.sum("entry").alias("n"), F.sum("key").alias("n_keys"))
    apart = F.col("source").isNull() | F.col("source_key").isNull()  # a null equals none, so neither side has the other's
    is_key, is_entry = F.col("n_keys") > 0, F.col("n") > 0
    keyed = F.array_compact(F.array(F.when(is_key & (~is_entry | apart), "is not classified"), F.when(is_entry & (~is_key | apart), "is not among the source keys"), F.when(F.col("n") > 1, "is classified more than once")))
    ruled = F.array_compact(F.array(F.when(F.col("known").isNull(), "names an unknown rule"), F.when(F.col("n") > 1, "names a rule more than once")))
    covered = entries.where(some & F.col("disposition").isin(list(schema.COVERING))).select(F.explode("rules").alias("rule_id")).distinct()
    plain = F.array_compact(F.array(F.when(backed & ~some, "names no rule"), F.when(~backed & some, "may not name rules"), F.when((F.col("disposition") != "implemented") & (F.coalesce(F.trim("note"), F.lit("")) == ""), "needs a note")))
    unruled = F.lit(None).cast("string").alias("rule_id")
    out = [
        met.select(*both, unruled, F.explode(keyed).alias("problem")),
        counted.select(*both, "rule_id", F.explode(ruled).alias("problem")),
        entries.select(*both, unruled, F.explode(plain).alias("problem")),
        row(rules.distinct().join(covered, "rule_id", "left_anti"), "no source covers it", None, None, "rule_id"),
    ]
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def tally(entries: DataFrame) -> DataFrame:
    """(disposition, n) for every disposition there is, those without entries included."""
    every = entries.sparkSession.createDataFrame([(d,) for d in schema.DISPOSITIONS], "disposition string")
    n = entries.groupBy("disposition").agg(F.count("*").alias("n"))
    return every.join(n, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))


def frames(spark, manifests: dict[str, dict], ids: set[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, keys and rules of a registry's manifests."""
    entries = [(name, e["source_key"], e["disposition"], list(e.get("rules", ())), e.get("note")) for name, doc in manifests.items() for e in doc["entries"]]
    keys = [(name, k) for name, doc in manifests.items() for k in doc["source_keys"]]
    return (
        spark.createDataFrame(entries, "source string, source_key string, disposition string, rules array<string>, note string"),
        spark.createDataFrame(keys, "source string, source_key string"), spark.createDataFrame([(i,) for i in sorted(ids)], "rule_id string"),
    )
