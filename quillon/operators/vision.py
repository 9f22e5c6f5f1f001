"""Photos before extraction: tags, text lines, face clusters and a closer look at a few, all put into meta."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalars import top_labels
from quillon.models.offline import Models
from quillon.operators.vector import face_clusters
from quillon.operators.windows import select_for_vision

_FACE = T.StructType([T.StructField("bbox", T.ArrayType(T.FloatType())), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _udf(f: Callable, kind: T.DataType, arrow: pa.DataType) -> Callable[[str], Column]:
    @F.arrow_udf(kind)
    def run(content: pa.Array) -> pa.Array:
        return pa.array([f(c) if c is not None else None for c in content.to_pylist()], arrow)

    return run


def tag_photos(files: DataFrame, models: Models) -> DataFrame:
    """(path, tags, ocr_lines, faces) of (path, content)."""
    tags = _udf(lambda c: list(models.tagger(c).items()), T.MapType(T.StringType(), T.FloatType()), pa.map_(pa.string(), pa.float32()))
    ocr = _udf(models.ocr, T.ArrayType(T.StringType()), pa.list_(pa.string()))
    faces = _udf(models.faces, T.ArrayType(_FACE), pa.list_(pa.struct([("bbox", pa.list_(pa.float32())), ("embedding", pa.list_(pa.float32()))])))
    return files.select("path", tags("content").alias("tags"), ocr("content").alias("ocr_lines"), faces("content").alias("faces"))


def describe(files: DataFrame, models: Models) -> DataFrame:
    """(path, photo_facts, vision_llm_error): a failure of the model is recorded, not raised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, errors = [], []
            for c in batch.column("content").to_pylist():
                try:
                    facts.append(json.dumps(models.photo_model(c)))
                    errors.append(None)
                except Exception as e:  # recorded per photo
                    facts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.record_batch([batch.column("path"), pa.array(facts, pa.string()), pa.array(errors, pa.string())], names=["path", "photo_facts", "vision_llm_error"])

    return files.select("path", "content").mapInArrow(run, "path string, photo_facts string, vision_llm_error string")


def enrich(items: DataFrame, files: DataFrame, models: Models, cap: int = 20) -> DataFrame:
    """Photo items with top tags, text lines, the labels of their faces and, for at most ``cap`` of them, what the
    photo model saw, in meta. ``files`` has (path, content) by media path."""
    tagged = tag_photos(files, models)
    hits = tagged.select("path", F.posexplode("faces").alias("k", "face")).select("path", F.concat_ws("#", "path", F.lpad(F.col("k").cast("string"), 6, "0")).alias("seq"), F.col("face.embedding").alias("embedding"))
    labels = face_clusters(hits, 0.4, "seq").where("label >= 0").join(hits.select("seq", "path"), "seq").groupBy("path").agg(F.sort_array(F.collect_set(F.concat(F.lit("face:"), F.col("label").cast("string")))).alias("face_labels"))
    dated = tagged.join(items.select(F.col("media_path").alias("path"), F.col("ts").alias("taken"), "seq"), "path")
    chosen = select_for_vision(dated, cap).select("path")
    seen = describe(files.join(chosen, "path", "left_semi"), models)
    extra = tagged.select("path", top_labels(F.col("tags")).alias("vision_tags"), "ocr_lines").join(labels, "path", "left").join(seen, "path", "left")
    joined = items.join(extra.withColumnRenamed("path", "media_path"), "media_path", "left")
    old = F.from_json("meta", "lat double, lon double, taken_source string, thread string")
    meta = F.to_json(F.struct(old["lat"].alias("lat"), old["lon"].alias("lon"), old["taken_source"].alias("taken_source"), old["thread"].alias("thread"), "vision_tags", "ocr_lines", "face_labels", "photo_facts", "vision_llm_error"))
    return joined.withColumn("meta", F.when(F.col("vision_tags").isNotNull(), meta).otherwise(F.col("meta"))).select(*items.columns)
