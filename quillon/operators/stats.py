"""Statistics of a store and the log of its runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import facts as fx
from quillon.operators.store import Store

# The fields of a run record.
RUN_RECORD = (
    "timestamp string, duration_s double, items long, windows_processed long, windows_skipped_extracted long, windows_skipped_gave_up long, facts_created long, facts_added long, "
    "dedup_hits long, retries long, escalations long, give_ups long, mentions long"
)


def append_run(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([record], RUN_RECORD).coalesce(1).write.mode("append").json(path)


def last_run(spark: SparkSession, path: str) -> dict | None:
    """The latest record, None without any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.schema(RUN_RECORD).json(path).where("timestamp is not null").orderBy(F.desc("timestamp")).limit(1).head(1)
    return row[0].asDict() if row else None


def _map(df: DataFrame, key: str, value: str = "n") -> dict:
    return {r[key]: r[value] for r in df.collect()}  # one row per source, kind or event


def stats(store: Store, runs: str | None = None, now: datetime | None = None) -> dict:
    """The counts of a store in one JSON-ready shape."""
    by_kind = fx.fact_stats(store.read("facts")).collect()
    total = next(r for r in by_kind if r["is_total"])
    queue = fx.confirm_queue(store.read("merge_proposals")).first()
    age = (now - queue["oldest"]).total_seconds() if now and queue["oldest"] else None
    return {
        "raw_items_by_source": _map(fx.counts_by_source(store.read("raw_items")), "source"),
        "facts": {"total": total["total"], "mean_confidence": total["mean_confidence"] or 0.0, "by_kind": {r["kind"]: {"total": r["total"], "mean_confidence": r["mean_confidence"]} for r in by_kind if not r["is_total"]}},
        "entities": fx.entity_count(store.read("entities")).first()["n"],
        "confirm_queue": {"pending": queue["pending"], "oldest_age_s": age},
        "fact_history_events": _map(fx.history_counts(store.read("fact_history")), "event"),
        "last_run": last_run(store.spark, runs) if runs else None,
    }
