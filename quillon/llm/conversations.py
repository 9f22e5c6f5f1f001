"""Conversations rebuilt from message rows.

Rows are keyed by channel (export and thread), reduced to the few columns that matter, and judged by aggregates per
conversation. The turns of the kept conversations are range-partitioned by (conversation, instant, line, id), so a
conversation of any size is spread over tasks; positions are ranks within a part plus the counts of the parts
before. Sessions split the ordered turns at inactivity gaps calibrated per source over all gaps.

In ``found`` a conversation is the whole thread, as this project's data define it; ``sessions`` gives the split at
gaps beside it, and drops sessions without reciprocal replies.

Defined results: rows with a null id, export or thread, or unreadable meta, belong to no conversation; an id
delivered again counts once; a blank sender counts as none; a null line sorts after all lines; ties of instant and
line go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.encoding import repaired
from quillon.operators.timestamps import with_instants
from quillon.session import settle_table, shuffle_width

# Names under which exports write the owner of the device.
OWNER_WORDS = ("me", "you")
#: Turns in one part of the range partition.
PART_ROWS = 500_000
#: Bounds of a calibrated gap in microseconds: ten minutes and one day.
LEAST_GAP, MOST_GAP = 600 * 1_000_000, 86_400 * 1_000_000

_VISIBLE = r"[^\p{Z}\s\p{Cc}\p{Cf}͏ᅟᅠ឴឵⠀ㅤ︀-️ﾠ]"
_EDGE = r"^[\p{Z}\s\p{Cf}]+|[\p{Z}\s\p{Cf}]+$"


def _meta(path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(__meta, '$.{path}', '{kind}')")


def channel(export_id: Column, thread: Column) -> Column:
    """The key of a conversation: phone numbers compare by their digits."""
    name = F.when(thread.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(thread, r"[^0-9]", ""))).otherwise(thread)
    return F.when(F.length(F.regexp_replace(thread, _EDGE, "")) > 0, F.concat_ws("\x1f", export_id, name))


def message_rows(items: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per distinct id with a channel: (id, channel, us, line, turn, role, broken, reply_to, source)."""
    owners = exports.where("export_id is not null").groupBy(F.col("export_id").alias("__e")).agg(F.max("owner").alias("__owner"))
    rows = with_instants(items.select("id", "source", "ts", "sender", "body", "media_path", "is_system", "meta", "export_id").where("id is not null and export_id is not null"), exports, "us")
    rows = rows.join(owners, rows["export_id"] == owners["__e"], "left").withColumn("__meta", F.expr("try_parse_json(meta)"))
    name = F.coalesce(F.nullif(F.when(F.col("sender").rlike(r"[^\x00-\x7F]"), repaired("sender")), F.lit("")), F.col("sender"))
    no_sender = F.coalesce(F.length(F.regexp_replace("sender", _EDGE, "")) == 0, F.lit(True))
    notice = F.coalesce(F.col("is_system"), no_sender)
    turn = ~notice & (F.coalesce(F.length("media_path") > 0, F.lit(False)) | F.coalesce(F.col("body").rlike(_VISIBLE), F.lit(False)))
    owner = F.coalesce((name == F.col("__owner")) | F.lower(F.trim(name)).isin(*OWNER_WORDS), F.lit(False))
    rows = rows.select(
        "id",
        channel(F.col("export_id"), _meta("thread", "string")).alias("channel"),
        "us",
        _meta("line", "long").alias("line"),
        turn.alias("turn"),
        F.when(owner, "owner").otherwise("contact").alias("role"),
        (turn & (no_sender | F.col("us").isNull())).alias("broken"),
        F.when(turn, _meta("reply_to", "string")).alias("reply_to"),
        F.lower("source").alias("source"),
    ).where("channel is not null")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", *(f"x.{c}" for c in rest))


def kept_channels(rows: DataFrame) -> DataFrame:
    """(channel): conversations with at least two turns, both roles, no broken turn and no dangling reply."""
    own = F.col("turn") & (F.col("role") == "owner")
    stats = rows.groupBy("channel").agg(F.count_if("turn").alias("turns"), F.count_if(own).alias("owner"), F.max("broken").alias("broken"))
    good = stats.where("turns >= 2 and owner > 0 and owner < turns and not broken").select("channel")
    wanted = rows.where("reply_to is not null").select("channel", F.col("reply_to").alias("id")).distinct()
    dangling = wanted.join(rows.select("channel", "id"), ["channel", "id"], "left_anti").select("channel").distinct()
    return good.join(dangling, "channel", "left_anti")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """The turns of the kept conversations: (channel, conv, pos, id, role, us, previous_us, source)."""
    spark = rows.sparkSession
    turns = rows.where("turn").join(kept_channels(rows), "channel", "left_semi").select("channel", "id", "us", F.coalesce("line", F.lit(2**62)).alias("line"), "role", "source")
    turns = settle_table(turns, "turns")
    order = ["us", "line", "id"]
    parts = max(shuffle_width(spark), turns.count() // PART_ROWS)
    placed = settle_table(turns.repartitionByRange(parts, "channel", *order).withColumn("part", F.spark_partition_id()), "placed")
    first = F.min(F.struct(*order))
    counts = placed.groupBy("channel", "part").agg(F.count("*").alias("n"), first.alias("first"), F.max("us").alias("last_us"))
    along = Window.partitionBy("channel").orderBy("part")  # at most one row per part
    offsets = counts.select(
        "channel",
        "part",
        (F.sum("n").over(along) - F.col("n")).alias("before"),
        F.first("first.id").over(along).alias("conv"),
        F.lag("last_us").over(along).alias("before_us"),
    )
    local = Window.partitionBy("part", "channel").orderBy(*order)
    ranked = placed.withColumn("rank", F.row_number().over(local)).withColumn("lag_us", F.lag("us").over(local))
    return ranked.join(offsets, ["part", "channel"]).select(
        "channel", "part", "conv", (F.col("rank") + F.col("before")).cast("long").alias("pos"), "id", "role", "us", F.coalesce("lag_us", "before_us").alias("previous_us"), "source"
    )


def conversations(items: DataFrame, exports: DataFrame) -> DataFrame:
    return ordered_turns(settle_table(message_rows(items, exports), "messages"))


def found(items: DataFrame, exports: DataFrame) -> DataFrame:
    return conversations(items, exports).select("conv", "pos", "id", "role")


def calibrated_gaps(turns: DataFrame) -> DataFrame:
    """(source, gap_us): the geometric mean of the 75th and 99th percentile of a source's gaps, within bounds."""
    gaps = turns.where("previous_us is not null").select("source", (F.col("us") - F.col("previous_us")).alias("g"))
    marks = gaps.groupBy("source").agg(F.percentile_approx("g", [0.75, 0.99], 10_000).alias("p"))
    middle = F.sqrt(F.greatest(F.element_at("p", 1), F.lit(1)).cast("double") * F.greatest(F.element_at("p", 2), F.lit(1)))
    return marks.select("source", F.greatest(F.lit(LEAST_GAP), F.least(F.lit(MOST_GAP), middle.cast("long"))).alias("gap_us"))


def sessions(items: DataFrame, exports: DataFrame) -> DataFrame:
    """(conv, session, n_turns, n_owner, start_us, end_us, replied): the kept conversations split at inactivity gaps,
    without the sessions in which only one role speaks, so that ``replied`` holds for all. Sessions are numbered
    before that."""
    turns = settle_table(conversations(items, exports), "ordered")
    marked = turns.join(calibrated_gaps(turns), "source", "left").withColumn("cut", F.coalesce(F.col("us") - F.col("previous_us") > F.col("gap_us"), F.lit(False)).cast("int"))
    marked = marked.withColumn("inside", F.sum("cut").over(Window.partitionBy("part", "channel").orderBy("pos")))
    along = Window.partitionBy("channel").orderBy("part")
    cuts = marked.groupBy("channel", "part").agg(F.sum("cut").alias("n"))
    before = cuts.select("channel", "part", (F.sum("n").over(along) - F.col("n")).alias("before"))
    numbered = marked.join(before, ["part", "channel"]).withColumn("session", (F.col("inside") + F.col("before") + 1).cast("long"))
    made = numbered.groupBy("conv", "session").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "owner").alias("n_owner"), F.min("us").alias("start_us"), F.max("us").alias("end_us")
    )
    return made.withColumn("replied", F.col("n_owner").between(1, F.col("n_turns") - 1)).where("replied")
