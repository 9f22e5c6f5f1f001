"""Session helpers shared by operators: table access, shared scratch space, partition sizing."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a checkpoint folder this session already
    has, else (a local master only) a temporary folder of this machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        _use(spark, conf)
        return conf
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def _use(spark: SparkSession, folder: str) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; the caller writes there."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, the default one where it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settle_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing a compressed table into the shared folder and reading it back. The table is
    removed by ``release``, or else when the driver's Python ends; a partition of it can be read again after an
    executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that ``settle_table`` returned as ``df``, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    for k, (spark, made) in enumerate(_made):
        if made == path:
            del _made[k]
            _delete(spark, path)
            return


def shared_file_dir(spark: SparkSession, label: str) -> Path:
    """A new folder under the shared one for files that plain Python writes and executors open; the shared folder must
    be mounted. It is removed with the other scratch."""
    path = scratch_path(spark, label)
    if ":" in path.split("/", 1)[0] and not path.startswith("file:"):
        raise ValueError(f"{path} is no mounted folder")
    _made.append((spark, path))
    at = Path("/" + path.split(":", 1)[-1].lstrip("/")) if path.startswith("file:") else Path(path)
    at.mkdir(parents=True)
    return at


_made: list[tuple[SparkSession, str]] = []


def remove_scratch() -> None:
    """Delete the tables that ``settle_table`` wrote."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the session may be gone already
            pass


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(remove_scratch)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, in case their Python does not find it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = scratch_path(spark, "package") + ".zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(data.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(qualified(spark, path))
