"""Vector search and clustering over embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import cosine
from quillon.operators.graph import components
from quillon.operators.ordered import with_number
from quillon.session import settle_table


def search(rows: DataFrame, query: list[float] | Column, limit: int, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """The rows nearest to ``query`` by cosine, nearest first; rows without a vector come last, ties go by id. The
    plan is one scan with a bounded top-k."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("similarity", F.round(cosine(F.col(embedding), q), 6)).orderBy(F.desc_nulls_last("similarity"), id_col).limit(limit)


#: Queries and rows multiplied at once.
BLOCK, ROW_BLOCK, CHUNK = 1024, 16_384, 4096


def nearest_batch(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, embedding: str = "embedding", floor: float | None = None) -> DataFrame:
    """(query_id, row_id, similarity, rank): for each query its ``k`` nearest rows, then those of at least
    ``floor``; ties go by row id. Queries and rows go in blocks of bounded size, each block of queries meets each block
    of rows in one task by matrix products, and k rows per query and pair of blocks go on. Neither side is collected."""
    kind_q, kind_r = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_r, out_s = [], [], []
        for n in {len(v) for v in a["v"].to_pylist()}:
            ids, unit = _unit(a, "q", n)
            names, other = _unit(b, "r", n)
            if not len(names):
                continue
            order = np.argsort(names, kind="stable")
            names, other = names[order], other[order]
            kept_s, kept_at = np.full((len(ids), 0), -2.0), np.zeros((len(ids), 0), np.int64)
            for at in range(0, len(names), CHUNK):
                s = np.round(unit @ other[at : at + CHUNK].T, 6)
                kept_s = np.hstack([kept_s, s])
                kept_at = np.hstack([kept_at, np.broadcast_to(np.arange(at, at + s.shape[1]), s.shape)])
                if kept_s.shape[1] > k:
                    # The columns stand in the order of their ids, so a stable sort settles ties.
                    keep = np.argsort(-kept_s, axis=1, kind="stable")[:, :k]
                    keep.sort(axis=1)
                    kept_s, kept_at = np.take_along_axis(kept_s, keep, 1), np.take_along_axis(kept_at, keep, 1)
            out_q.append(np.repeat(ids, kept_s.shape[1]))
            out_r.append(names[kept_at.ravel()])
            out_s.append(kept_s.ravel())
        columns = [np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_r, out_s)]
        return pa.table({"q": pa.array(columns[0].tolist(), _arrow(kind_q)), "r": pa.array(columns[1].tolist(), _arrow(kind_r)), "similarity": pa.array(columns[2].tolist(), pa.float64())})

    met = _blocks_meet(queries, rows, query_id, row_id, embedding, best)
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "r")  # k rows per block of rows
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if floor is not None:
        ranked = ranked.where(F.col("similarity") >= floor)
    return ranked.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "similarity", "rank")


def similar(queries: DataFrame, rows: DataFrame, floor: float, query_id: str, row_id: str, embedding: str = "embedding") -> DataFrame:
    """(query_id, row_id, similarity): all rows of at least ``floor`` for each query, in blocks like ``nearest_batch``."""
    kind_q, kind_r = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for n in {len(v) for v in a["v"].to_pylist()}:
            ids, unit = _unit(a, "q", n)
            names, other = _unit(b, "r", n)
            for at in range(0, len(names), CHUNK):
                s = np.round(unit @ other[at : at + CHUNK].T, 6)
                x, y = np.nonzero(s >= floor)
                for column, values in zip(out, (ids[x], names[at + y], s[x, y])):
                    column.extend(values.tolist())
        return pa.table({"q": pa.array(out[0], _arrow(kind_q)), "r": pa.array(out[1], _arrow(kind_r)), "similarity": pa.array(out[2], pa.float64())})

    met = _blocks_meet(queries, rows, query_id, row_id, embedding, near)
    return met.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "similarity")


def _blocks_meet(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, embedding: str, meet) -> DataFrame:
    """(q, r, similarity) that ``meet`` makes of each block of queries (q, v) and each block of rows (r, v)."""
    q = queries.select(F.col(query_id).alias("q"), F.col(embedding).cast("array<float>").alias("v")).where("q is not null and v is not null")
    r = rows.select(F.col(row_id).alias("r"), F.col(embedding).cast("array<float>").alias("v")).where("r is not null and v is not null")
    blocks_q, blocks_r = (max(1, -(-df.count() // most)) for df, most in ((q, BLOCK), (r, ROW_BLOCK)))
    left = q.withColumn("bq", F.pmod(F.xxhash64("q"), F.lit(blocks_q)).cast("int")).withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(blocks_r - 1))))
    right = r.withColumn("br", F.pmod(F.xxhash64("r"), F.lit(blocks_r)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))
    kinds = f"q {dict(q.dtypes)['q']}, r {dict(r.dtypes)['r']}, similarity double"
    return left.groupBy("bq", "br").cogroup(right.groupBy("bq", "br")).applyInArrow(meet, kinds)


def _unit(rows: pa.Table, key: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose vectors have ``n`` numbers, zero vectors as they are."""
    vectors = rows["v"].combine_chunks()
    ok = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == n)
    ids = np.array(rows[key].to_pylist(), object)[ok]
    flat = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.nan_to_num(flat).reshape(len(ok), n)
    size = np.linalg.norm(m, axis=1)
    return ids, m / np.where(size == 0, 1, size)[:, None]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


#: Vectors in one side of a block comparison.
BLOCK_ROWS = 2048


def near_pairs(rows: DataFrame, eps: float, id_col: str, embedding: str = "embedding") -> DataFrame:
    """(a, b): pairs of rows at a cosine distance of at most ``eps``. Unit vectors that near differ by at most
    sqrt(2 eps) in every direction, so rows are cut into slabs of that width along one fixed direction and only met
    with their own slab and the next. Slabs are cut into blocks of bounded size; a task compares two blocks by one
    matrix product and emits the near pairs alone."""
    kind = dict(rows.dtypes)[id_col]
    width = float(np.sqrt(2 * eps)) + 1e-9

    @F.arrow_udf("long")
    def slab_of(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors.to_pylist():
            x = np.array([np.nan if e is None else e for e in v or []], np.float64)
            d = np.sin(np.arange(1, len(x) + 1) * 12.9898)
            size = np.linalg.norm(x) * np.linalg.norm(d) if len(x) else 0.0
            out.append(int(np.floor(x @ d / size / width)) if size > 0 else None)
        return pa.array(out, pa.int64())

    placed = rows.select(F.col(id_col).alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id is not null and v is not null")
    placed = settle_table(placed.withColumn("slab", slab_of("v")).where("slab is not null"), "slabs")
    counts = placed.groupBy("slab").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = placed.join(counts, "slab").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    following = counts.select((F.col("slab") - 1).alias("slab"), F.col("blocks").alias("next_blocks"))
    left = placed.join(following, "slab", "left")
    own = F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda k: F.struct(F.col("slab").alias("slab_b"), k.alias("block_b")))
    more = F.when(F.col("next_blocks") > 0, F.transform(F.sequence(F.lit(0), F.col("next_blocks") - 1), lambda k: F.struct((F.col("slab") + 1).alias("slab_b"), k.alias("block_b"))))
    key = ["slab", "block", "slab_b", "block_b"]
    left = left.withColumn("to", F.explode(F.concat(own, F.coalesce(more, F.array().cast("array<struct<slab_b:bigint,block_b:int>>"))))).select("slab", "block", "to.slab_b", "to.block_b", "id", "v")
    before = counts.select((F.col("slab") + 1).alias("slab"), F.col("blocks").alias("before_blocks"))
    right = placed.join(before, "slab", "left")
    mine = F.transform(F.sequence(F.lit(0), F.col("block")), lambda k: F.struct(F.col("slab").alias("slab_a"), k.alias("block_a")))
    earlier = F.when(F.col("before_blocks") > 0, F.transform(F.sequence(F.lit(0), F.col("before_blocks") - 1), lambda k: F.struct((F.col("slab") - 1).alias("slab_a"), k.alias("block_a"))))
    right = right.withColumn("to", F.explode(F.concat(mine, F.coalesce(earlier, F.array().cast("array<struct<slab_a:bigint,block_a:int>>")))))
    right = right.select(F.col("to.slab_a").alias("slab"), F.col("to.block_a").alias("block"), F.col("slab").alias("slab_b"), F.col("block").alias("block_b"), F.col("id").alias("id_b"), F.col("v").alias("v_b"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ia, ib = a["id"].to_pylist(), b["id_b"].to_pylist()
        out_a, out_b = [], []
        if ia and ib:
            va, vb = a["v"].to_pylist(), b["v_b"].to_pylist()
            for n in {len(v) for v in va} & {len(v) for v in vb}:
                ka, kb = [k for k, v in enumerate(va) if len(v) == n], [k for k, v in enumerate(vb) if len(v) == n]
                ma, mb = (np.array([v[k] for k in ks], np.float64) for v, ks in ((va, ka), (vb, kb)))
                near = np.round(1 - (ma / np.linalg.norm(ma, axis=1)[:, None]) @ (mb / np.linalg.norm(mb, axis=1)[:, None]).T, 9) <= eps
                same = a["slab"][0] == b["slab_b"][0] and a["block"][0] == b["block_b"][0]
                for x, y in zip(*np.nonzero(near)):
                    p, q = ia[ka[x]], ib[kb[y]]
                    if p != q and (not same or p < q):
                        out_a.append(min(p, q))
                        out_b.append(max(p, q))
        return pa.table({"a": pa.array(out_a, _arrow(kind)), "b": pa.array(out_b, _arrow(kind))})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"a {kind}, b {kind}")


def face_clusters(hits: DataFrame, eps: float = 0.4, id_col: str = "seq", embedding: str = "embedding") -> DataFrame:
    """(id, label): density clusters with two points at least, which are the components of the eps graph; -1 is
    noise, labels count by first appearance."""
    pairs = near_pairs(hits, eps, id_col, embedding)
    parts = components(pairs)
    labels = with_number(parts.select("component").distinct(), ["component"], "label").withColumn("label", F.col("label") - 1)
    found = parts.join(labels, "component").select(F.col("vertex").alias(id_col), "label")
    return hits.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
