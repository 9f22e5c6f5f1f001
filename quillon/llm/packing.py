"""Filling containers of a fixed number of tokens with documents, little space unused and similar texts together.

Documents are placed in shards by their words: cells of a spherical k-means over hashed BM25 weights, fitted on a
sample of ``SAMPLE`` documents, and cells of cells where one is too large, so that a document's neighbours stand in
its shard. Each shard builds an inverted index with BM25 weights; document frequencies and the mean length come from
the whole corpus. The largest unused document seeds a container, the index returns its unused neighbours, best
first and by all words of the seed, which fill the container greedily; what room is left goes to the largest unused
documents that fit. A document is split only if it alone exceeds the capacity: into full containers and one
remainder, which is packed like a document.

Defined results: null and empty documents have no tokens and join the first container of their shard; repeated rows
are packed as often as they occur; ties of size go by document id; a budget with a null or non-positive capacity is
ignored. The placement depends on the rows alone, not on files or partitions.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.tokens import TOKENIZERS, token_counts
from quillon.session import settle_table

#: Hashed terms (bounds the frequency table), documents and tokens in a shard.
TERMS, SHARD_DOCS, SHARD_TOKENS = 1 << 18, 50_000, 20_000_000
K1, B = 1.2, 0.75
#: Cells of one level and documents for each of them at least, dimensions of the hashed weights, sampled documents that a
#: fit takes, its rounds, and levels of cells; a cell beyond the last level that is too large is cut by a hash.
CELLS, CELL_DOCS, DIMENSIONS, SAMPLE, ROUNDS, LEVELS = 8, 500, 512, 4096, 12, 2
#: Starts of a fit.
STARTS = 4
#: A term is wide if more than one in so many documents of the shard have it.
DENSE = 16

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]{2}|[^\W\d_]{2,}")


def terms_of(text: str | None) -> Counter[int]:
    """Hashed words of a text with their counts; pairs of characters where a script has no spaces."""
    return Counter(zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % TERMS for w in _WORD.findall(text or ""))


def weigh(terms: np.ndarray, counts: np.ndarray, owner: np.ndarray, lengths: np.ndarray, df: np.ndarray, docs: int, mean: float) -> np.ndarray:
    """The BM25 weight of each (document, term) posting."""
    known = np.maximum(df[terms], 1)
    idf = np.log(1 + (docs - known + 0.5) / (known + 0.5))
    return (idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[owner] / max(mean, 1e-9)))).astype(np.float32)


class Index:
    """A shard's inverted index: per term the documents and their BM25 weights."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, df: np.ndarray, docs: int, mean: float) -> None:
        self.n = len(terms)
        sizes = np.fromiter(map(len, terms), np.int64, self.n)
        owner = np.repeat(np.arange(self.n), sizes)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float32) if terms else np.zeros(0, np.float32)
        weight = weigh(term, tf, owner, lengths, df, docs, mean)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = owner[order], weight[order]
        known, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(term))
        # The places of each document's terms among the known ones.
        self.slots, self.slot_starts = np.searchsorted(known, term), np.append(0, np.cumsum(sizes))
        # Terms of very many documents as whole rows of weights, which add up faster than lists; there are DENSE times
        # the terms of a document at most.
        df_here = np.diff(self.starts)
        wide = np.flatnonzero(df_here * DENSE > self.n)
        self.row_of = np.full(len(known), -1, np.int64)
        self.row_of[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.n), np.float32)
        for row, t in enumerate(wide.tolist()):
            self.rows[row, self.docs[self.starts[t] : self.starts[t + 1]]] = self.weights[self.starts[t] : self.starts[t + 1]]
        lists = np.ones(len(known), bool)
        lists[wide] = False
        keep = np.repeat(lists, df_here)
        self.starts = np.append(0, np.cumsum(np.where(lists, df_here, 0)))
        self.docs, self.weights = self.docs[keep], self.weights[keep]

    def view(self) -> "View":
        return View(self)


class View:
    """The index for one packing. Each time half of its documents are used they leave the postings: ``at`` are the
    documents that stand in it, ``place`` their places there."""

    def __init__(self, index: Index) -> None:
        self.index, self.docs, self.weights, self.starts, self.rows = index, index.docs, index.weights, index.starts, index.rows
        self.at = np.arange(index.n)
        self.place = np.arange(index.n)

    def compact(self, unused: np.ndarray) -> bool:
        """Drop the used documents if they are half of those that stand here; ``unused`` is by document."""
        keep = unused[self.at]
        if 2 * int(keep.sum()) > len(self.at):
            return False
        moved = np.cumsum(keep) - 1
        listed = keep[self.docs]
        self.starts = np.append(0, np.cumsum(listed))[self.starts]
        self.docs, self.weights = moved[self.docs[listed]], self.weights[listed]
        self.rows, self.at = np.ascontiguousarray(self.rows[:, keep]), self.at[keep]
        self.place = np.full(self.index.n, -1, np.int64)
        self.place[self.at] = np.arange(len(self.at))
        return True

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document that stands here, for all terms of ``doc``."""
        slots = self.index.slots[self.index.slot_starts[doc] : self.index.slot_starts[doc + 1]]
        rows = self.index.row_of[slots]
        out = np.zeros(len(self.at), np.float32)
        for row in rows[rows >= 0].tolist():
            out += self.rows[row]
        for a, b in zip(self.starts[slots].tolist(), self.starts[slots + 1].tolist()):
            if a < b:
                out[self.docs[a:b]] += self.weights[a:b]  # a term has a document once
        return out


def best_first(scores: np.ndarray, able: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best of the able documents with a score, best first, ties by number; all that tie with the last."""
    near = np.flatnonzero(able & (scores > 0))
    if len(near) > most:
        least = np.partition(scores[near], len(near) - most)[len(near) - most]
        near = near[scores[near] >= least]
    return near[np.lexsort((near, -scores[near]))]


def pack(sizes: np.ndarray, capacity: int, index: Index, items: np.ndarray) -> np.ndarray:
    """The container number of each item; ``items`` are document numbers of the index, each of at most capacity."""
    n = len(sizes)
    container = np.full(n, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ascending = order[::-1]
    by_size = sizes[ascending]  # for the search of the largest that fits
    skip = np.arange(-1, n)  # skip[k + 1]: the last position <= k that is unused, path-compressed
    unused = np.ones(n, bool)
    item_of = np.full(index.n, -1, np.int64)
    item_of[items] = np.arange(n)
    size_of = np.zeros(index.n, np.int64)
    size_of[items] = sizes
    unused_doc = np.zeros(index.n, bool)
    unused_doc[items] = True
    view = index.view()
    free, size_at = unused_doc.copy(), size_of  # by place in the view

    def last_unused(k: int) -> int:
        path = []
        while k >= 0 and not unused[ascending[k]]:
            path.append(k)
            k = int(skip[k + 1]) if skip[k + 1] != k else k - 1
        for p in path:
            skip[p + 1] = k
        return k

    place = view.place

    def take(i: int, number: int) -> None:
        container[i] = number
        unused[i] = False
        unused_doc[items[i]] = False
        if (k := place[items[i]]) >= 0:
            free[k] = False

    number = 0
    sizes_list, ascending_sizes = sizes.tolist(), by_size.tolist()
    for seed in order.tolist():
        if not unused[seed]:
            continue
        take(seed, number)
        room = capacity - sizes_list[seed]
        if room > 0 and last_unused(bisect_right(ascending_sizes, room) - 1) >= 0:
            if view.compact(unused_doc):
                place, free, size_at = view.place, unused_doc[view.at], size_of[view.at]
            scores = view.scores(int(items[seed]))
            most = 32
            while room > 0:  # what does not fit now will not later
                near = best_first(scores, free & (size_at <= room), most)
                if not len(near):
                    break
                for i in item_of[view.at[near]].tolist():
                    if sizes_list[i] <= room:
                        take(i, number)
                        room -= sizes_list[i]
                most *= 4
        while room >= 0:
            k = last_unused(bisect_right(ascending_sizes, room) - 1)
            if k < 0 or (room == 0 and sizes_list[ascending[k]] > 0):
                break
            i = int(ascending[k])
            take(i, number)
            room -= sizes_list[i]
        number += 1
    return container


def vectors(terms: list, counts: list, df: np.ndarray, docs: int, mean: float) -> np.ndarray:
    """Unit vectors of hashed BM25 weights, all zero for a document without words."""
    n = len(terms)
    out = np.zeros((n, DIMENSIONS), np.float32)
    sizes = np.fromiter((len(t) for t in terms), np.int64, n)
    if not sizes.sum():
        return out
    owner = np.repeat(np.arange(n), sizes)
    term = np.concatenate([np.asarray(t, np.int64) for t in terms if len(t)])
    tf = np.concatenate([np.asarray(c, np.float32) for c in counts if len(c)])
    weight = weigh(term, tf, owner, np.bincount(owner, tf, n), df, docs, mean)
    out += np.bincount(owner * DIMENSIONS + term % DIMENSIONS, weight, n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a spherical k-means, the best of several starts; the draws are fixed."""
    tries = [_fit(x, min(cells, len(x)), np.random.default_rng(start)) for start in range(STARTS)]
    return max(tries, key=lambda c: float(np.max(x @ c.T, axis=1).sum()))


def _fit(x: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    centres = [x[int(rng.integers(len(x)))]]
    far = 1 - x @ centres[0]
    for _ in range(cells - 1):
        chance = np.maximum(far, 0) ** 2
        if not chance.sum() > 0:
            break
        tried = rng.choice(len(x), 8, p=chance / chance.sum())  # the one that leaves least becomes a centre
        best = min(tried.tolist(), key=lambda j: float(np.minimum(far, 1 - x @ x[j]).sum()))
        centres.append(x[best])
        far = np.minimum(far, 1 - x @ x[best])
    c = np.array(centres)
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (at == j).any():
                m = x[at == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def placed(sized: DataFrame, df: np.ndarray, docs: int, tokens: int, mean: float, shard_docs: int, shard_tokens: int) -> DataFrame:
    """``sized`` with its ``shard``: nested cells of similar documents, of bounded size."""
    spark = sized.sparkSession
    frequency = spark.sparkContext.broadcast(df)  # TERMS integers, one megabyte
    tree: dict[str, np.ndarray] = {}

    def with_cell(rows: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
        @F.arrow_udf(T.StringType())
        def cell(terms: pa.Array, counts: pa.Array) -> pa.Array:
            x = vectors(terms.to_pylist(), counts.to_pylist(), frequency.value, docs, mean)
            out = np.full(len(x), "", object)
            todo = [("", np.arange(len(x)))]
            while todo:
                name, at = todo.pop()
                if name not in known or not len(at):
                    continue
                nearest = np.argmax(x[at] @ known[name].T, axis=1)
                for j in range(len(known[name])):
                    out[at[nearest == j]] = f"{name}.{j}"
                    todo.append((f"{name}.{j}", at[nearest == j]))
            return pa.array(out.tolist(), pa.string())

        return rows.withColumn("cell", cell("terms", "counts"))

    at = {"": (docs, tokens)}  # the cells of a level are CELLS ** LEVELS at most
    rows = sized.withColumn("cell", F.lit(""))
    for level in range(LEVELS):
        large = {name: n for name, (n, t) in at.items() if n > shard_docs or t > shard_tokens}
        if not large:
            break
        # The documents with the least hashes are the sample, whatever the partitions.
        drawn = F.xxhash64("doc_id", "n_tokens")
        share = F.lit(0.0)
        for name, n in large.items():
            share = F.when(F.col("cell") == name, F.lit(min(1.0, 1.5 * SAMPLE / n))).otherwise(share)
        few = rows.where(F.size("terms") > 0).withColumn("drawn", drawn).where(F.col("drawn") / F.lit(2.0**64) + 0.5 < share)
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("drawn", "doc_id"))  # about 1.5 SAMPLE rows a cell
        sample: dict[str, list] = {}
        for r in few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("cell", "terms", "counts").orderBy("cell", "rank").toLocalIterator():
            sample.setdefault(r.cell, []).append((r.terms, r.counts))
        fitted = {name: vectors([t for t, _ in s], [c for _, c in s], df, docs, mean) for name, s in sample.items()}
        tree.update({name: fit(x, max(2, min(CELLS, large[name] // CELL_DOCS))) for name, x in fitted.items()})
        rows = settle_table(with_cell(sized, dict(tree)), "cells")
        at = {r.cell: (r.n, r.t) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).collect()}
    cuts = F.lit(1)
    for name, (n, t) in at.items():
        if (k := max(math.ceil(n / shard_docs), math.ceil(t / shard_tokens))) > 1:
            cuts = F.when(F.col("cell") == name, F.lit(k)).otherwise(cuts)
    return rows.withColumn("shard", F.concat_ws("/", "cell", F.pmod(F.xxhash64("doc_id", "n_tokens"), cuts).cast("string"))).drop("cell")


def containers(documents: DataFrame, budgets: DataFrame, folder: str = TOKENIZERS, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(budget_name, capacity_tokens, container, doc_id, part, first_token, n_tokens) for every budget."""
    rows = budgets.where("capacity_tokens > 0").select("budget_name", "tokenizer", F.col("capacity_tokens").cast("long")).collect()  # a table of settings
    schema = "budget_name string, capacity_tokens long, container string, doc_id long, part int, first_token long, n_tokens long"
    made = [_contained(documents, [(r.budget_name, r.capacity_tokens) for r in rows if r.tokenizer == t], t, schema, folder, shard_docs, shard_tokens) for t in sorted({r.tokenizer for r in rows})]
    if not made:
        return documents.sparkSession.createDataFrame([], schema)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _sized(documents: DataFrame, tokenizer: str, folder: str) -> tuple[DataFrame, np.ndarray, int, int, float]:
    """(doc_id, n_tokens, terms, counts) of the documents, document frequencies, documents, tokens, mean length."""

    @F.arrow_udf(T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
    def term_lists(text: pa.Array) -> pa.Array:
        found = [terms_of(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([list(c.keys()) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["terms", "counts"]
        )

    sized = documents.select(F.col("doc_id").cast("long"), token_counts(documents, "text", folder, tokenizer).alias("n_tokens"), term_lists("text").alias("x"))
    sized = settle_table(sized.select("doc_id", "n_tokens", "x.terms", "x.counts"), "sized")
    docs, tokens, mean = sized.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.avg(F.aggregate("counts", F.lit(0), lambda a, b: a + b))).first()
    frequency = sized.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # at most TERMS rows
    df = np.zeros(TERMS, np.int32)
    for t, n in frequency:
        df[t] = n
    return sized, df, docs, tokens, mean or 0.0


def _contained(documents: DataFrame, budgets: list[tuple[str, int]], tokenizer: str, schema: str, folder: str, shard_docs: int, shard_tokens: int) -> DataFrame:
    sized, df, docs, tokens, mean = _sized(documents, tokenizer, folder)
    shared = documents.sparkSession.sparkContext.broadcast(df)  # TERMS integers, one megabyte
    in_shards = placed(sized, df, docs, tokens, mean, shard_docs, shard_tokens)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        shard = table["shard"][0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "descending")])
        ids, sizes = table["doc_id"].to_pylist(), table["n_tokens"].to_numpy()
        terms = [np.asarray(t, np.int64) for t in table["terms"].to_pylist()]
        counts = [np.asarray(c, np.int64) for c in table["counts"].to_pylist()]
        lengths = np.array([c.sum() for c in counts], np.float64)
        index = Index(terms, counts, lengths, shared.value, docs, mean)
        for name, capacity in budgets:
            out: list[tuple] = []
            rest, rest_part, rest_from = [], [], []
            for d, n in enumerate(sizes.tolist()):
                whole = n // capacity if n > capacity else 0
                for p in range(whole):
                    out.append((name, capacity, f"{shard}-{d}-{p}", ids[d], p, p * capacity, capacity))
                if n - whole * capacity or not whole:
                    rest.append(d)
                    rest_part.append(whole)
                    rest_from.append(whole * capacity)
            items = np.array(rest, np.int64)
            left = sizes[items] - np.array(rest_from, np.int64) if rest else np.zeros(0, np.int64)
            for d, part, start, n, c in zip(rest, rest_part, rest_from, left.tolist(), pack(left, capacity, index, items).tolist()):
                out.append((name, capacity, f"{shard}-{c}", ids[d], part, start, n))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ["budget_name", "capacity_tokens", "container", "doc_id", "part", "first_token", "n_tokens"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return in_shards.groupBy("shard").applyInArrow(fill, schema)


def neighbours(documents: DataFrame, every: int = 50, most: int = 10, folder: str = TOKENIZERS, tokenizer: str = "byte_bpe_50k", **limits: int) -> tuple[int, int]:
    """(found, wanted): how many of the ``most`` best documents by BM25 over the whole corpus stand in the shard of
    the documents whose id is divisible by ``every``. A measure for tests and reports: the index of the whole corpus
    is built on the driver."""
    sized, df, docs, tokens, mean = _sized(documents, tokenizer, folder)
    rows = placed(sized, df, docs, tokens, mean, limits.get("shard_docs", SHARD_DOCS), limits.get("shard_tokens", SHARD_TOKENS)).orderBy("doc_id", "n_tokens").toPandas()
    terms, counts = [np.asarray(t, np.int64) for t in rows["terms"]], [np.asarray(c, np.int64) for c in rows["counts"]]
    view = Index(terms, counts, np.array([c.sum() for c in counts], np.float64), df, docs, mean).view()
    shard = rows["shard"].to_numpy()
    found = wanted = 0
    for d in np.flatnonzero(rows["doc_id"].to_numpy() % every == 0).tolist():
        scores = view.scores(d)
        scores[d] = 0
        n = min(most, int((scores > 0).sum()))
        if n:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            wanted += n
            found += min(n, int((scores[shard == shard[d]] >= least - 1e-9).sum()))
    return found, wanted


def fill_report(packed: DataFrame) -> DataFrame:
    """(budget_name, capacity_tokens, containers, items, tokens, unused_tokens) per budget."""
    each = packed.groupBy("budget_name", "capacity_tokens", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return each.groupBy("budget_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity_tokens") - F.col("tokens")).alias("unused_tokens")
    )
