"""Chat text exports: bracket and dash headers, multi-line messages, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.common import local_to_utc, normalized, stem

# The two header forms (day first in brackets, month first before a dash) and the attachment that begins a
# message, in its two forms.
BRACKET = r"^\[(\d{1,2})/(\d{1,2})/(\d{2,4}), (\d{1,2}):(\d{2})(?::(\d{2}))?\][\s\x{A0}\x{202F}](.*)$"
DASH = r"^(\d{1,2})/(\d{1,2})/(\d{2,4}), (\d{1,2}):(\d{2})(?::(\d{2}))?[\s\x{A0}\x{202F}]?([AaPp][Mm])? - (.*)$"
ATTACHED = r"(?U)^[\x{200E}\x{200F}]*(?:<attached:\s*([^>]+)>|([\w\- ]+\.\w+)\s\(file attached\))"


#: The end of a line as ``$`` takes it, before a last line separator or after it.
_END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def _field(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def _header(line: Column) -> Column:
    """Year, month, day, hour, minute, second, half of the day and the rest of a header line, by one match."""
    bracket = F.regexp_replace(line, BRACKET[:-1] + _END, "$3\x1f$2\x1f$1\x1f$4\x1f$5\x1f$6\x1f\x1f$7")
    dash = F.regexp_replace(line, DASH[:-1] + _END, "$3\x1f$1\x1f$2\x1f$4\x1f$5\x1f$6\x1f$7\x1f$8")
    return F.split(F.when(line.startswith("["), bracket).otherwise(dash), "\x1f", 8)


def _wall(header: Column) -> Column:
    year, month, day, hour, minute, second, half = (F.nullif(header[k], F.lit("")) for k in range(7))
    year, hour, half = year.cast("int"), hour.cast("int"), F.lower(half)
    hour = F.when(half.isNull(), hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.try_to_timestamp(F.format_string("%04d-%s-%s %02d:%s:%s", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"), hour, minute, F.coalesce(second, F.lit("00"))))


def _messages(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the exports with the number of their line and their message within the file. A file is read in
    splits; lines and headers are counted within each and carried over from the splits before, of which a file has few."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^[\u200e\u200f]+", "").alias("line"))
    lines = lines.withColumn("header", F.col("line").rlike(BRACKET) | F.col("line").rlike(DASH))
    sums = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.count_if("header").alias("headers"))
    along = Window.partitionBy("file").orderBy("split")  # one row per split
    before = sums.select("file", "split", (F.sum("n").over(along) - F.col("n")).alias("lines_before"), (F.sum("headers").over(along) - F.col("headers")).alias("headers_before"))
    within = Window.partitionBy("file", "split").orderBy("place")
    local = lines.withColumn("line_no", F.row_number().over(within) - 1).withColumn("message", F.sum(F.col("header").cast("int")).over(within)).where("line <> ''")
    carried = local.join(before, ["file", "split"])
    return carried.select("file", (F.col("line_no") + F.col("lines_before")).cast("int").alias("line_no"), "line", (F.col("message") + F.col("headers_before")).alias("message"))


def read_chat_text(spark: SparkSession, path: str, source_tz: str, thread: str | None = None) -> DataFrame:
    """Items of one or many chat exports. ``source_tz`` is an IANA zone, so old times keep the offset of their day.
    Lines before the first header belong to no message; ``orphan_lines`` counts them."""
    lines = _messages(spark, path).where("message > 0")
    made = lines.groupBy("file", "message").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    made = made.withColumn("first", F.col("x")[0]["line"]).withColumn("rest", F.transform(F.slice("x", 2, 1_000_000_000), lambda l: l["line"]))
    # What is used more than once is a column of its own, or it is worked out anew for each use.
    made = made.withColumn("header", _header(F.col("first")))
    made = made.withColumn("body", F.concat_ws("\n", F.array(F.col("header")[7]), F.col("rest"))).withColumn("cut", F.instr("body", ": "))
    made = made.withColumn("sender", F.when(F.col("cut") > 0, F.substr("body", F.lit(1), F.col("cut") - 1))).withColumn("full", F.when(F.col("cut") > 0, F.substr("body", F.col("cut") + 2)).otherwise(F.col("body")))
    made = made.withColumn("media_path", F.when(F.col("sender").isNotNull() & F.col("full").rlike(ATTACHED), F.coalesce(_field(F.col("full"), ATTACHED, 1), _field(F.col("full"), ATTACHED, 2))))
    left = F.regexp_replace(F.regexp_replace("full", ATTACHED, ""), r"^\s+|\s+$", "")
    made = made.withColumn("text", F.when(F.col("media_path").isNotNull(), F.nullif(left, F.lit(""))).otherwise(F.col("full")))
    name = F.lit(thread) if thread else stem(F.col("file"))
    return normalized(
        made.select(
            F.lit("whatsapp").alias("source"), name.alias("thread"), local_to_utc(_wall(F.col("header")), source_tz).alias("ts"), "sender", "text", "media_path",
            F.col("sender").isNull().alias("is_system"), F.to_json(F.struct(name.alias("thread"), F.col("x")[0]["line_no"].alias("line"))).alias("meta"),
            F.concat(F.lit("whatsapp:"), name).alias("source_group"), F.col("message").cast("long").alias("seq"),
        )
    )


def orphan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lines before the first header of each file, for one warning per file."""
    return _messages(spark, path).where("message = 0").groupBy("file").agg(F.count("*").alias("n"))
