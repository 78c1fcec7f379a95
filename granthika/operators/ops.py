"""Changed documents, lineage, metric gates, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as K


def latest(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *ties)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def changed(manifest: DataFrame, lineage: DataFrame) -> DataFrame:
    """Documents without lineage or with another hash."""
    old = lineage.select("doc_id", F.col("sha256").alias("old_sha"))
    j = manifest.join(old, "doc_id", "left")
    return j.filter(F.col("old_sha").isNull() | (F.col("sha256") != F.col("old_sha"))).withColumn("change", F.when(F.col("old_sha").isNull(), "new").otherwise("modified"))


def checksum_changes(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Null-safe difference of stored and present checksums."""
    return now.join(stored, "key", "left").filter(~F.col("sum").eqNullSafe(F.col("stored")))


def affected_shards(changed_docs: DataFrame, lineage: DataFrame) -> DataFrame:
    """J10."""
    return changed_docs.select("doc_id").join(lineage, "doc_id").select(F.explode("shard_ids").alias("shard_id")).distinct()


def regressions(gates: DataFrame, current: DataFrame) -> DataFrame:
    """Metrics that fell below their baseline by more than the threshold, with severity."""
    j = gates.filter(F.col("baseline") > 0).join(current, "metric").withColumn("ratio", (F.col("baseline") - F.col("current")) / F.col("baseline"))
    return j.filter(F.col("ratio") > F.col("threshold")).withColumn("severity", K.severity(F.col("ratio"), F.col("threshold"))).withColumn("rollback", F.col("is_critical") & F.col("severity").isin("moderate", "severe")).withColumn("approval", F.col("ratio") > 0.10)


def simple_regressions(gates: DataFrame, current: DataFrame) -> DataFrame:
    """Critical metrics below 95 % of their baseline."""
    return gates.filter("is_critical").join(current, "metric").filter(F.col("current") < F.col("baseline") * 0.95)


def metric_changes(gates: DataFrame, current: DataFrame) -> DataFrame:
    """Union of both metric sets with absolute changes and changes in per cent of the baseline (of 1 where there is none)."""
    j = gates.select("metric", "baseline").join(current, "metric", "full")
    diff = F.coalesce("current", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0))
    return j.select("metric", diff.alias("absolute"), (diff / F.greatest(F.coalesce("baseline", F.lit(1.0)), F.lit(0.001)) * 100).alias("relative"))


#: Recommendations of a safety report; those of a metric hold from moderate severity on.
NO_REGRESSION = "✅ No regressions detected. Safe to proceed."
CRITICAL_ADVICE = " critical metric(s) regressed. Consider rolling back or investigating root cause."
SEVERE_ADVICE = " metric(s) show severe regression. Manual review recommended before proceeding."
METRIC_ADVICE = {
    "authority_purity": "🔍 Authority purity regression detected. Check if distractor documents are being ranked higher than authoritative sources.",
    "citation_precision": "📝 Citation precision regression. Verify citation extraction and bbox mapping accuracy.",
    "citation_recall": "🔎 Citation recall regression. Check if relevant citations are being missed or filtered out.",
}
ROLLBACK_ADVICE = "🔄 Auto-rollback will be triggered due to critical regressions."
APPROVAL_ADVICE = "✋ Manual approval required before proceeding."


def safety_report(found: DataFrame) -> DataFrame:
    """Summary of the regressions and what to do, in one row; the gates are few."""
    g = found.agg(F.count("*").alias("total"), F.count_if("is_critical").alias("critical"), F.count_if(F.col("severity") == "severe").alias("severe"), F.coalesce(F.bool_or("rollback"), F.lit(False)).alias("rollback"), F.coalesce(F.bool_or("approval"), F.lit(False)).alias("approval"), F.collect_set(F.when(F.col("severity") != "minor", F.col("metric"))).alias("_m"))
    lines = F.array(
        F.when(F.col("total") == 0, NO_REGRESSION),
        F.when(F.col("critical") > 0, F.concat(F.lit("🚨 "), F.col("critical").cast("string"), F.lit(CRITICAL_ADVICE))),
        F.when(F.col("severe") > 0, F.concat(F.lit("⚠️ "), F.col("severe").cast("string"), F.lit(SEVERE_ADVICE))),
        *[F.when(F.array_contains("_m", m), text) for m, text in METRIC_ADVICE.items()],
        F.when(F.col("rollback"), ROLLBACK_ADVICE).when(F.col("approval"), APPROVAL_ADVICE),
    )
    return g.select("total", "critical", "severe", "rollback", "approval", F.array_join(F.array_compact(lines), "\n").alias("recommendations"))


def changelog(changes: DataFrame, run: str) -> DataFrame:
    """One entry for each changed document of a run."""
    return changes.select(F.lit(run).alias("run"), "doc_id", F.concat("change", F.lit(": "), "doc_id", F.lit(" ("), F.substring("sha256", 1, 12), F.lit(")")).alias("entry"))


def upserted(manifest: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lineage after an update: the first retrieval stays the time of adding, a new or changed document waits, others keep their state and shards."""
    m = manifest.groupBy("doc_id").agg(F.min("retrieved_at").alias("added_at"), F.max_by("sha256", F.struct("retrieved_at", "sha256")).alias("sha256"))
    old = latest(lineage, "doc_id", "last_processed", "sha256").select("doc_id", F.col("sha256").alias("_sha"), F.col("status").alias("_status"), "shard_ids")
    j = m.join(old, "doc_id", "full")
    same = F.col("sha256").isNull() | F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False))
    return j.select("doc_id", "added_at", F.coalesce("sha256", "_sha").alias("sha256"), F.when(same, F.col("_status")).otherwise("pending").alias("status"), "shard_ids")


def kept_backups(df: DataFrame, newest: int, days: int) -> DataFrame:
    """Backups in order, those kept (the newest, of no more than so many days before the owner's last), and the one to return to (the second newest, else the newest)."""
    last = F.max("at").over(Window.partitionBy("owner"))
    w = Window.partitionBy("owner").orderBy(F.desc("at"), "backup_id")
    n = F.count("*").over(Window.partitionBy("owner"))
    return df.withColumn("nth", F.row_number().over(w)).withColumn("is_kept", (F.col("nth") <= newest) & (F.col("at") >= last - F.expr(f"interval {days} days"))).withColumn("is_restore_point", F.col("nth") == F.least(F.lit(2), n))
