"""Records that are equal but for formatting: one record each, with its number of copies.

Every statement gets canonical bytes. These are partitioned recursively by radix: a bucket that is too large is split
at the first byte in which its keys differ, until each bucket fits; small siblings share a bucket. The plan is a
table, never on the driver: a level reads the rows of its open buckets alone. Copies of one statement are counted
before that, per partition, so a statement that a third of all rows repeat reaches its bucket as a few rows. Each
bucket is then counted in a burst trie with terminal counters.

Defined results: a null or blank statement, or one of punctuation only, belongs to no group; rows with a null id
are left out; an id delivered twice with the same statement counts once. Long statements are taken whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import settle_table

# The labels of statements that are made of fields.
LABELS = ("who", "what", "where", "when", "with", "seats")
#: Rows that fit into one bucket.
FITS = 200_000

_MARK = r"[\p{P}=|~^`<>]"
_DROP = regex.compile(rf"[\p{{Z}}\p{{C}}]+|(?<!\p{{Nd}}){_MARK}|{_MARK}(?!\p{{Nd}})")
_FIELD = regex.compile(r"(?:^|[;|,{\n\r\t]|\s\|)[\s\p{P}]*?\b(" + "|".join(LABELS) + r")\b[\"'\s]*[:=]", regex.IGNORECASE)
_LEAD = regex.compile(r"^[\s\p{P}|=]*")


def canonical(statement: str | None) -> str:
    """The comparable form: NFC, case folded, without white space and punctuation, a mark between two digits kept.
    A statement of labelled fields becomes its sorted fields. Empty for a statement without content."""
    if not statement:
        return ""
    text = unicodedata.normalize("NFC", statement)
    if ":" in text or "=" in text:
        labels = list(_FIELD.finditer(text))
        if len(labels) >= 2 and _LEAD.match(text).end() >= labels[0].start(1):
            ends = [m.start() for m in labels[1:]] + [len(text)]
            fields = sorted((m[1].lower(), _plain(text[m.end() : end])) for m, end in zip(labels, ends))
            return "\x1e".join(f"{k}\x1f{v}" for k, v in fields)
    return _plain(text)


def _plain(text: str) -> str:
    return _DROP.sub("", unicodedata.normalize("NFC", text.casefold()))


@F.arrow_udf(T.BinaryType())
def canonical_bytes(statement: pa.Array) -> pa.Array:
    seen: dict[str | None, bytes] = {}
    out = []
    for s in statement.to_pylist():
        b = seen.get(s)
        if b is None:
            b = seen[s] = canonical(s).encode("utf-8", "surrogatepass")
        out.append(b)
    return pa.array(out, pa.binary())


def _shared_siblings(fits: int):
    """Gives the prefixes of one split bucket, 256 at most, their buckets: siblings in order share one as long as they
    fit together. A bucket is named by its first prefix."""

    def share(prefixes: pa.Table) -> pa.Table:
        rows = sorted(prefixes.select(["prefix", "n", "lo", "hi"]).to_pylist(), key=lambda r: r["prefix"])
        out, room = [], -1
        for r in rows:
            if r["n"] > fits:
                out.append((r["prefix"], r["lo"] != r["hi"]))
                room = -1
            else:
                if room < r["n"]:
                    name, room = r["prefix"], fits
                out.append((name, False))
                room -= r["n"]
        columns = [pa.array([prefixes["bucket"][0].as_py()] * len(rows), pa.binary()), pa.array([r["prefix"] for r in rows], pa.binary())]
        return pa.table([*columns, pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.bool_())], names=["bucket", "prefix", "into", "open"])

    return share


@F.arrow_udf(T.IntegerType())
def _cut_at(lo: pa.Array, hi: pa.Array) -> pa.Array:
    """The length of the shortest prefix in which two keys differ."""
    return pa.array([len(commonprefix([a, b])) + 1 for a, b in zip(lo.to_pylist(), hi.to_pylist())], pa.int32())


def radix_buckets(rows: DataFrame, fits: int) -> DataFrame:
    """``rows`` with the ``bucket`` of their ``key``: at most ``fits`` rows, or one key only. A bucket's name is a
    prefix of its keys or of a sibling's, so no two buckets have one name."""
    total = rows.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    whole = rows.withColumn("bucket", F.lit(b"").cast("binary"))
    if total["n"] <= fits or total["lo"] == total["hi"]:
        return whole
    done, todo = [], whole
    while True:
        # Only the open buckets' rows are read again; a level multiplies the buckets by up to 256.
        ends = todo.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select("bucket", _cut_at("lo", "hi").alias("cut"))
        cut = todo.join(ends, "bucket").withColumn("prefix", F.expr("substring(key, 1, cut)"))
        counts = cut.groupBy("bucket", "prefix").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        plan = settle_table(counts.groupBy("bucket").applyInArrow(_shared_siblings(fits), "bucket binary, prefix binary, into binary, open boolean"), "radix")
        placed = cut.join(plan, ["bucket", "prefix"]).drop("bucket", "prefix", "cut").withColumnRenamed("into", "bucket")
        if not plan.where("open").head(1):
            done.append(placed.drop("open"))
            return functools.reduce(DataFrame.unionByName, done)
        placed = settle_table(placed, "placed")
        done.append(placed.where("not open").drop("open"))
        todo = placed.where("open").drop("open")


class BurstTrie:
    """Terminal counters under byte strings: containers of remainders that burst into a node, four bytes a step,
    when they grow."""

    BURST, STEP = 4096, 4
    __slots__ = ("nodes", "ends")

    def __init__(self) -> None:
        self.nodes: dict[bytes, dict | BurstTrie] = {}
        self.ends: dict[bytes, list] = {}

    def add(self, key: bytes, n: int, least: str) -> None:
        step, trie = self.STEP, self
        while True:
            if len(key) < step:
                box, rest = trie.ends, key
                break
            head, key = key[:step], key[step:]
            below = trie.nodes.get(head)
            if below is None:
                below = trie.nodes[head] = {}
            if isinstance(below, dict):
                box, rest = below, key
                if len(box) >= self.BURST and rest not in box:
                    burst = trie.nodes[head] = BurstTrie()
                    for k, (c, i) in box.items():
                        burst.add(k, c, i)
                    trie = burst
                    continue
                break
            trie = below
        counter = box.get(rest)
        if counter is None:
            box[rest] = [n, least]
        else:
            counter[0] += n
            if least < counter[1]:
                counter[1] = least

    def counters(self) -> Iterator[list]:
        yield from self.ends.values()
        for below in self.nodes.values():
            if isinstance(below, dict):
                yield from below.values()
            else:
                yield from below.counters()


def _count(rows: pa.Table) -> pa.Table:
    trie = BurstTrie()
    for key, n, least in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), rows["least"].to_pylist()):
        trie.add(key, n, least)
    ends = list(trie.counters())
    return pa.table({"keep_id": pa.array([e[1] for e in ends], pa.string()), "copies": pa.array([e[0] for e in ends], pa.int64())})


def collapse(facts: DataFrame, id_col: str = "id", text_col: str = "statement", fits: int = FITS) -> DataFrame:
    """(keep_id, copies): one row per distinct statement, with the smallest id and the number of distinct ids."""
    keyed = facts.select(F.col(id_col).cast("string").alias("id"), canonical_bytes(F.col(text_col)).alias("key")).where("id is not null and length(key) > 0")
    once = keyed.groupBy("key", "id").agg(F.lit(1).alias("one"))
    counted = once.withColumn("at", F.spark_partition_id()).groupBy("key", "at").agg(F.count("*").alias("n"), F.min("id").alias("least")).drop("at")
    placed = radix_buckets(settle_table(counted, "statements"), fits)
    return placed.groupBy("bucket").applyInArrow(_count, "keep_id string, copies long")


def found(facts: DataFrame) -> DataFrame:
    return collapse(facts).where("copies >= 2")
