"""References to records that do not exist.

Keys of the parent tables are cut into ranges of about ``RANGE_KEYS`` keys, at least one for each task there is. Per
range the parents are stored as one row of sorted arrays; the references of the range come in bounded batches and are
looked up in them by binary search. A range that many references point at (one hot key may hold a third of them) is
cut into several batches, each of which gets the range's stored arrays, so no task holds an unbounded group. Only the
misses go on. The driver learns one bound per range, from a sample that Spark sorts.

Defined results: null and blank elements are no references; repeats within a fact count once, as does a fact that
was delivered again (its earliest created_at counts); a fact with a null id is left out; a null created_at gives a
null period and is never late; a parent whose arrival is null is present and never late. Parent rows with a null
key are ignored. A key of more than ``LONG_KEY`` characters is compared by its sha256.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import with_number
from quillon.session import settle_table, shuffle_width

#: Keys in a range; fewer, but not below the second number, where there are tasks to spare.
RANGE_KEYS, LEAST_KEYS = 1_000_000, 20_000
#: References in one batch.
BATCH = 400_000
#: Sampled keys per range, drawn by a hash; the sample only places the boundaries. Rows of it that one task sorts.
SAMPLED, SAMPLE_PART = 64, 1_000_000
LONG_KEY = 64
_BLANK = r"^[\p{Z}\p{Cc}\p{Cf}]*|[\p{Z}\p{Cc}\p{Cf}]*$"


def uuid_key(c: Column) -> Column:
    """A UUID in any notation as 8-4-4-4-12 lower-case digits; other texts trimmed and lower-case."""
    text = F.lower(F.regexp_replace(c, _BLANK, ""))
    digits = F.regexp_replace(text, r"^urn:uuid:|[{}()\-]", "")
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(text)


def plain_key(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def _probe_key(table: str, key: Column) -> Column:
    return F.concat(F.lit(table + "\t"), F.when(F.length(key) > LONG_KEY, F.concat(F.lit("#"), F.sha2(key, 256))).otherwise(key))


def _bytes(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The keys as fixed-width bytes, without a Python object for each. The closing byte keeps numpy from cutting
    trailing zero bytes."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    n = len(keys)
    if not n:
        return np.zeros(0, "S1")
    keys = keys.cast(pa.large_binary())
    _, at, data = keys.buffers()
    at = np.frombuffer(at, np.int64, n + 1, keys.offset * 8)
    sizes = np.diff(at)
    width = int(sizes.max()) + 1
    out = np.zeros((n, width), np.uint8)
    inside = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], sizes)
    if len(inside):
        out[np.repeat(np.arange(n), sizes), inside] = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0]))
    out[np.arange(n), sizes] = 1
    return out.view(f"S{width}").ravel()


def _range_udf(bounds: list[str]):
    edges = np.array([b.encode() + b"\x01" for b in bounds], dtype="S") if bounds else np.zeros(0, "S1")

    @F.arrow_udf("int")
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, _bytes(key), side="right").astype(np.int32))

    return range_of


_ARRAYS = "range int, width int, keys binary, present binary, first binary, deleted binary"


def _sorted_arrays(parents: pa.Table) -> pa.Table:
    """The parents of a range as one row of arrays in the order of their keys."""
    keys = _bytes(parents["key"])
    order = np.argsort(keys, kind="stable")
    present = pc.fill_null(parents["present"], False).to_numpy()[order]
    first = pc.fill_null(parents["first_us"], np.iinfo(np.int64).min).to_numpy()[order].astype(np.int64)
    deleted = pc.fill_null(parents["deleted"], False).to_numpy()[order]
    row = [parents["range"][0].as_py(), keys.dtype.itemsize, keys[order].tobytes(), present.astype(np.uint8).tobytes(), first.tobytes(), deleted.astype(np.uint8).tobytes()]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=["range", "width", "keys", "present", "first", "deleted"])


def _probe(arrays: pa.Table, refs: pa.Table) -> pa.Table:
    wanted = _bytes(refs["key"])
    n = len(wanted)
    present, first, deleted = np.zeros(n, bool), np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)
    if len(arrays):
        keys = np.frombuffer(arrays["keys"][0].as_buffer(), f"S{arrays['width'][0].as_py()}")
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        present = hit & np.frombuffer(arrays["present"][0].as_buffer(), np.uint8)[at].astype(bool)
        deleted = hit & np.frombuffer(arrays["deleted"][0].as_buffer(), np.uint8)[at].astype(bool)
        first = np.frombuffer(arrays["first"][0].as_buffer(), np.int64)[at]
    created = pc.fill_null(refs["created_us"], np.iinfo(np.int64).max).to_numpy()
    late = present & (first > created)
    state = np.where(late, "late", np.where(deleted, "deleted", "missing"))
    keep = late | ~present
    miss = refs.filter(pa.array(keep))
    return pa.table({"fact_id": miss["fact_id"], "ref_table": miss["ref_table"], "ref_id": miss["ref_id"], "created_us": miss["created_us"], "state": pa.array(state[keep].astype(object), pa.string())}, schema=_MISS)


_MISS = pa.schema([("fact_id", pa.string()), ("ref_table", pa.string()), ("ref_id", pa.string()), ("created_us", pa.int64()), ("state", pa.string())])


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _parents(raw_items: DataFrame, entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    def rows(df: DataFrame, table: str, key: Column, arrived: str | None) -> DataFrame:
        return df.where(key.isNotNull()).select(
            _probe_key(table, key).alias("key"),
            F.lit(arrived is not None).alias("present"),
            (_micros(F.col(arrived)) if arrived else F.lit(None).cast("long")).alias("first_us"),
            F.lit(arrived is None).alias("deleted"),
        )

    gone = tombstones.select(F.lower(F.trim("table_name")).alias("table_name"), "record_key")
    all_rows = (
        rows(raw_items, "raw_items", plain_key(F.col("id")), "ingested_at")
        .unionByName(rows(entities, "entities", uuid_key(F.col("id")), "created_at"))
        .unionByName(rows(gone.where("table_name = 'raw_items'"), "raw_items", plain_key(F.col("record_key")), None))
        .unionByName(rows(gone.where("table_name = 'entities'"), "entities", uuid_key(F.col("record_key")), None))
    )
    return all_rows.groupBy("key").agg(F.max("present").alias("present"), F.min("first_us").alias("first_us"), F.max("deleted").alias("deleted"))


def _references(facts: DataFrame) -> DataFrame:
    def refs(column: str, table: str, key) -> DataFrame:
        keys = F.array_distinct(F.filter(F.transform(F.col(column), key), lambda x: x.isNotNull() & (x != "")))
        one = facts.where(F.col("id").isNotNull()).select(F.col("id").alias("fact_id"), _micros(F.col("created_at")).alias("created_us"), F.explode(keys).alias("ref_id"))
        return one.withColumn("ref_table", F.lit(table)).withColumn("key", _probe_key(table, F.col("ref_id")))

    return refs("provenance", "raw_items", plain_key).unionByName(refs("entity_ids", "entities", uuid_key))


def _bounds(parents: DataFrame, n: int, ranges: int) -> list[str]:
    """The first keys of all ranges but one: every ``SAMPLED``-th key of a sorted sample of the keys."""
    if ranges < 2:
        return []
    sample = parents.select("key").where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (ranges * SAMPLED)))) == 0)
    numbered = with_number(sample, ["key"], "place", SAMPLE_PART)
    step = max(1, numbered.count() // ranges)
    return sorted(r[0] for r in numbered.where(F.col("place") % step == 0).select("key").collect())[: ranges - 1]  # one key per range


def orphan_references(facts: DataFrame, raw_items: DataFrame, entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(ref_table, period, fact_id, ref_id, state): one row per fact and distinct reference whose target has no row
    (``deleted`` or ``missing``) or arrived after the fact (``late``)."""
    spark = facts.sparkSession
    parents = settle_table(_parents(raw_items, entities, tombstones), "parents")
    n = parents.count()
    ranges = max(1, math.ceil(n / RANGE_KEYS), min(shuffle_width(spark), n // LEAST_KEYS))
    range_of = _range_udf(_bounds(parents, n, ranges))
    arrays = parents.withColumn("range", range_of("key")).groupBy("range").applyInArrow(_sorted_arrays, _ARRAYS)
    arrays = settle_table(arrays, "arrays")
    refs = settle_table(_references(facts).withColumn("range", range_of("key")), "references")
    counts = refs.groupBy("range").agg(F.count("*").alias("n"))
    cut = counts.select("range", F.ceil(F.col("n") / BATCH).cast("int").alias("batches"))  # one row per range
    left = arrays.join(cut, "range").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")
    right = refs.join(cut, "range").withColumn("batch", F.expr("cast(pmod(xxhash64(fact_id, ref_id), batches) as int)"))
    right = right.select("range", "batch", "key", "fact_id", "ref_table", "ref_id", "created_us")
    missed = left.groupBy("range", "batch").cogroup(right.groupBy("range", "batch")).applyInArrow(_probe, "fact_id string, ref_table string, ref_id string, created_us long, state string")
    rank = F.when(F.col("state") == "late", 0).when(F.col("state") == "deleted", 1).otherwise(2)
    one = missed.groupBy("ref_table", "fact_id", "ref_id").agg(F.min("created_us").alias("created_us"), F.max_by("state", rank).alias("state"))
    return one.select("ref_table", F.date_format(F.timestamp_micros("created_us"), "yyyy-MM").alias("period"), "fact_id", "ref_id", "state")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphan references and the facts that hold them, counted per table, period and state."""
    per_fact = orphans.groupBy("ref_table", "period", "state", "fact_id").agg(F.count("*").alias("n"))
    return per_fact.groupBy("ref_table", "period", "state").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_facts"))
