"""Streaming: idempotent ingest, gap sessions over event time, and extraction with a retryable watermark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.models.offline import BagEmbedder
from quillon.operators.extract import embed, extract, flattened, outcome, window_transcripts
from quillon.operators.store import Store
from quillon.session import settle_table


def first_deliveries(items: DataFrame, within: str = "1 day", ts: str = "ingested_at") -> DataFrame:
    """Items without those delivered again ``within`` the watermark; the state is bounded by it."""
    return items.withWatermark(ts, within).dropDuplicatesWithinWatermark(["id"])


def ingest(items: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of items with insert-or-ignore: a batch that is repeated after a failure adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.add_raw_items(batch)

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "180 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions of event time that close once the watermark has passed them. Events later
    than ``late`` are dropped by the watermark."""
    sessions = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def extract_new_windows(items: DataFrame, store: Store, extractor: Callable[[str, bool], dict], retry_failed: bool = False, now: datetime | None = None, embedder: BagEmbedder | None = None) -> dict:
    """Extract the windows of these items that have no outcome yet; windows that gave up are tried again on
    request. A window whose members changed has a new hash and is extracted anew; facts are deduplicated by
    statement, so that adds nothing twice. Facts get vectors, without which no search would find them."""
    at = now or datetime.now(timezone.utc)
    if retry_failed:
        store.clear_given_up()
    windows = window_transcripts(items)
    results = settle_table(extract(store.pending_windows(windows), extractor), "extracted")
    facts = settle_table(embed(flattened(results), "statement", embedder or BagEmbedder()), "facts")
    stored = store.add_facts(facts, at)
    n = stored.count()
    store.mark_windows(results, outcome(), at)
    return {"windows": results.count(), "facts": n, "results": results}


def extract_stream(items: DataFrame, store: Store, extractor: Callable[[str, bool], dict], checkpoint: str, embedder: BagEmbedder | None = None) -> StreamingQuery:
    """Ingest and extract each micro-batch. The store's outcome table, not the stream's checkpoint, says which
    windows are done, so that only failed ones can be retried."""

    def run(batch: DataFrame, _: int) -> None:
        groups = batch.select("source_group").distinct()
        store.add_raw_items(batch)
        # Windows need their whole group, not only its new items.
        extract_new_windows(store.read("raw_items").join(groups, "source_group", "left_semi"), store, extractor, embedder=embedder)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
