"""Sequence operators: conversation windows, sessions, round-robin selection, first-wins and latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import best_label, combined_score, month_bucket
from quillon.identity import window_hash
from quillon.operators import ordered
from quillon.operators.ordered import in_parts, largest_group, with_lags, with_neighbours, with_running_sum
from quillon.schemas import UNSEEN_LABELS


def with_islands(items: DataFrame, group: list[str], order: list[str], ts: str = "ts", gap_minutes: int = 180, alone: Column | None = None) -> DataFrame:
    """Adds ``island``, a new one beginning where the gap to the row before is longer than ``gap_minutes`` (both
    times known) and around rows that stand ``alone``, and ``rank``, the row's place in its group. A group too
    large for one task is spread over several."""
    rows = items.withColumn("__alone", F.coalesce(alone, F.lit(False)) if alone is not None else F.lit(False))
    rows = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    breaks = F.coalesce(F.col("__us") - F.col("__us_before") > gap_minutes * 60_000_000, F.lit(False)) | (F.col("__alone") & F.col("__alone_before").isNotNull()) | F.coalesce("__alone_before", F.lit(False))
    lags = {"__us_before": "__us", "__alone_before": "__alone"}
    if largest_group(items, group) <= ordered.GROUP_ROWS:
        w = Window.partitionBy(*group).orderBy(*order)
        for name, c in lags.items():
            rows = rows.withColumn(name, F.lag(c).over(w))
        rows = rows.withColumn("__break", breaks.cast("int")).withColumn("island", F.sum("__break").over(w)).withColumn("rank", F.row_number().over(w))
        return rows.drop("__alone", "__us", "__break", *lags)
    parts = in_parts(rows, group, order)
    marked = with_lags(parts, group, order, lags)
    marked = with_running_sum(marked, group, order, breaks.cast("int"), "island")
    return with_running_sum(marked, group, order, F.lit(1), "rank").drop("__alone", "__us", "__part", *lags)


def conversation_windows(items: DataFrame, group: list[str], order: list[str], id_col: str = "id", ts: str = "ts", max_msgs: int = 40, gap_minutes: int = 180, alone: Column | None = None) -> DataFrame:
    """(group, window_no, n_items, ids, window_hash): chronological slices of at most ``max_msgs`` items in input
    order. The ids of a window are bounded by ``max_msgs``."""
    marked = with_islands(items, group, order, ts, gap_minutes, alone)
    starts = marked.groupBy(*group, "island").agg(F.min("rank").alias("__start"))
    cut = marked.join(starts, [*group, "island"]).withColumn("chunk", F.floor((F.col("rank") - F.col("__start")) / max_msgs).cast("int"))
    sequence = F.struct(*order, F.col(id_col).alias("__id"))
    made = cut.groupBy(*group, "island", "chunk").agg(F.sort_array(F.collect_list(sequence)).alias("__items"))
    made = made.withColumn("ids", F.transform("__items", lambda x: x["__id"].cast("string")))
    numbered = made.withColumn("window_no", F.row_number().over(Window.partitionBy(*group).orderBy("island", "chunk")))
    return numbered.select(*group, "window_no", F.size("ids").alias("n_items"), "ids", window_hash(F.col("ids")).alias("window_hash"))


def session_gaps(events: DataFrame, key: str, ts: str, gap_minutes: int = 180) -> DataFrame:
    """(key, session_no, n, start_us, end_us) of gap-only sessions."""
    marked = with_islands(events, [key], [ts], ts, gap_minutes)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    made = marked.groupBy(key, "island").agg(F.count("*").alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))
    return made.select(key, (F.col("island") + 1).alias("session_no"), "n", "start_us", "end_us")


def nearest_counterparty(items: DataFrame, owner: str = "me", group: str = "source_group") -> DataFrame:
    """``items`` (group, ts, seq, sender) with ``counterparty``: the sender, or for the owner's own messages who else of
    the group spoke nearest in time; of equally near ones the earlier. Null where nobody else spoke."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    other = F.when(F.col("sender").isNotNull() & (F.col("sender") != owner), True)
    rows = items.withColumn("__us", us)
    # The value rises along the order; of one instant the first stands for all on the left side.
    left = F.when(other, F.struct("__us", (-F.col("seq")).alias("__no"), "sender"))
    right = F.when(other, F.struct("__us", F.col("seq").alias("__no"), "sender"))
    rows = with_neighbours(rows, [group], ["__us", "seq"], left, right, "__before", "__after")
    behind, ahead = F.col("__us") - F.col("__before.__us"), F.col("__after.__us") - F.col("__us")
    near = F.when(F.col("__after").isNull() | (behind <= ahead), F.col("__before.sender")).otherwise(F.col("__after.sender"))
    return rows.withColumn("counterparty", F.when(other, F.col("sender")).otherwise(near)).drop("__us", "__before", "__after")


def select_for_vision(photos: DataFrame, cap: int, with_dates: bool = True) -> DataFrame:
    """The ``cap`` photos (path, tags, taken, seq) that get a closer look: best scores first, or round-robin over
    months. Photos whose best label tells that nobody is on them are left out."""
    kept = photos.where(~F.coalesce(best_label(F.col("tags")).isin(*UNSEEN_LABELS), F.lit(False))).withColumn("score", combined_score(F.col("tags")))
    if not with_dates:
        return kept.orderBy(F.desc("score"), "seq").limit(cap)
    return round_robin(kept.withColumn("month", F.coalesce(month_bucket(F.col("taken")), F.lit(""))), "month", "score", "seq", cap)


def round_robin(rows: DataFrame, bucket: str, score: str, seq: str, cap: int) -> DataFrame:
    """One row of each bucket in turn, the best remaining one; buckets in their order."""
    w = Window.partitionBy(bucket).orderBy(F.desc(score), seq)
    return rows.withColumn("round", F.row_number().over(w)).where(F.col("round") <= cap).orderBy("round", bucket).limit(cap)


def first_by_min(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, as an aggregate: it combines before the shuffle, so no key is too large."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*key, *(F.col(f"__x.{c}").alias(c) for c in rest)).select(*rows.columns)


def latest(rows: DataFrame, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(1)
