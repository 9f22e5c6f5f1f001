"""Extraction of facts from windows: an attempt loop per window inside the executors, flattening, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import transcript_line
from quillon.identity import window_hash
from quillon.models.offline import BagEmbedder
from quillon.operators.windows import with_islands
from quillon.schemas import FACT_KINDS

# Attempts per window, and the attempt from which the stronger model answers.
MOST_ATTEMPTS, ESCALATES_AT = 3, 3

_FIELDS = {"kind", "statement", "subjects", "place", "happened_at", "confidence"}
_RESULT = "attempt int, last_error string, facts array<struct<kind: string, statement: string, subjects: array<string>, place: string, happened_at: string, confidence: double>>, notes string"


def validated(result: object) -> dict:
    """The strict check of a model's answer; a ValueError says what is wrong."""
    if not isinstance(result, dict) or not isinstance(result.get("facts"), list):
        raise ValueError("facts: a list is required")
    if extra := set(result) - {"facts", "notes"}:
        raise ValueError(f"unknown fields {sorted(extra)}")
    out = []
    for k, f in enumerate(result["facts"]):
        if not isinstance(f, dict) or set(f) - _FIELDS:
            raise ValueError(f"facts[{k}]: unknown fields {sorted(set(f) - _FIELDS) if isinstance(f, dict) else ''}")
        if f.get("kind") not in FACT_KINDS:
            raise ValueError(f"facts[{k}].kind: one of {', '.join(FACT_KINDS)}")
        if not isinstance(f.get("statement"), str) or not f["statement"].strip():
            raise ValueError(f"facts[{k}].statement: a text is required")
        c = f.get("confidence", 0.0)
        if not isinstance(c, (int, float)) or not 0 <= c <= 1:
            raise ValueError(f"facts[{k}].confidence: between 0 and 1")
        if not isinstance(f.get("subjects", []), list):
            raise ValueError(f"facts[{k}].subjects: a list")
        out.append({"kind": f["kind"], "statement": f["statement"], "subjects": f.get("subjects") or [], "place": f.get("place"), "happened_at": f.get("happened_at"), "confidence": float(c)})
    return {"facts": out, "notes": result.get("notes")}


def attempt(transcript: str, extractor: Callable[[str, bool], dict]) -> dict:
    """Up to three tries; an error goes into the next prompt. No facts at all is a success, null facts a failure."""
    error = None
    for n in range(1, MOST_ATTEMPTS + 1):
        prompt = transcript if error is None else f"{transcript}\n\nThe last answer was not usable: {error}\nAnswer again."
        try:
            return {"attempt": n, "last_error": None, **validated(extractor(prompt, n >= ESCALATES_AT))}
        except Exception as e:  # a model may fail in any way; the window alone is lost
            error = f"{type(e).__name__}: {e}"[:500]
    return {"attempt": MOST_ATTEMPTS, "last_error": error, "facts": None, "notes": None}


def window_transcripts(items: DataFrame, max_msgs: int = 40, gap_minutes: int = 180) -> DataFrame:
    """(source_group, window_hash, provenance, transcript) of items as the readers make them; photos stand alone.
    OCR lines and tags come from meta."""
    marked = with_islands(items, ["source_group"], ["seq"], "ts", gap_minutes, F.col("source") == "photo")
    starts = marked.groupBy("source_group", "island").agg(F.min("rank").alias("start"))
    marked = marked.join(starts, ["source_group", "island"]).withColumn("chunk", F.floor((F.col("rank") - F.col("start")) / max_msgs))
    meta = F.from_json("meta", "ocr_lines array<string>, vision_tags array<string>")
    line = transcript_line(F.col("sender"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("text"), F.coalesce(meta["ocr_lines"], F.array()), F.coalesce(meta["vision_tags"], F.array()))
    made = marked.withColumn("line", line).groupBy("source_group", "island", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "id", "line"))).alias("x"))
    ids = F.transform("x", lambda x: x["id"])
    return made.select("source_group", window_hash(ids).alias("window_hash"), ids.alias("provenance"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("transcript"))


def extract(windows: DataFrame, extractor: Callable[[str, bool], dict], parallel: int | None = None) -> DataFrame:
    """Windows with attempt, last_error, facts and notes. Write the result before using it twice: model calls are
    costly and a lost partition would repeat them. ``parallel`` bounds the calls at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("statement", pa.string()), ("subjects", pa.list_(pa.string())), ("place", pa.string()), ("happened_at", pa.string()), ("confidence", pa.float64())])
        for batch in batches:
            done = [attempt(t or "", extractor) for t in batch.column("transcript").to_pylist()]
            more = [pa.array([d["attempt"] for d in done], pa.int32()), pa.array([d["last_error"] for d in done], pa.string()), pa.array([d["facts"] for d in done], pa.list_(kind)), pa.array([d["notes"] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "attempt", "last_error", "facts", "notes"])

    spread = windows.repartition(parallel) if parallel else windows
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return spread.mapInArrow(run, f"{columns}, {_RESULT}")


def flattened(results: DataFrame) -> DataFrame:
    """One row per fact, with every item of its window as provenance and a seq in window order."""
    each = results.where("facts is not null").select("source_group", "window_hash", "provenance", F.posexplode("facts").alias("n", "f"))
    rows = each.select("window_hash", "provenance", "n", "f.*")
    # The order is by hash and place: stable, and made without one global sort.
    return rows.withColumn("seq", F.xxhash64("window_hash").cast("decimal(20,0)") * 1000 + F.col("n")).drop("n")


def counters(results: DataFrame) -> DataFrame:
    """(windows, retries, escalations, give_ups, facts): one row."""
    return results.agg(
        F.count("*").alias("windows"), F.coalesce(F.sum(F.col("attempt") - 1), F.lit(0)).alias("retries"), F.count_if(F.col("attempt") >= ESCALATES_AT).alias("escalations"),
        F.count_if(F.col("facts").isNull()).alias("give_ups"), F.coalesce(F.sum(F.size("facts")), F.lit(0)).alias("facts"),
    )


def outcome() -> Column:
    return F.when(F.col("facts").isNull(), "gave_up").otherwise("extracted")


def embed(rows: DataFrame, text: str, embedder: BagEmbedder, to: str = "embedding") -> DataFrame:
    """Document vectors in Arrow batches; the embedder is loaded once per worker."""

    @F.arrow_udf("array<float>")
    def vectors(t: pa.Array) -> pa.Array:
        return pa.array(embedder.embed_docs([x or "" for x in t.to_pylist()]), pa.list_(pa.float32()))

    return rows.withColumn(to, vectors(F.col(text)))


