"""Token ids of every document by a public byte-level BPE tokenizer.

The frequent words of the whole corpus are compiled, with their ids, into a minimal acyclic transducer: suffixes
are shared, and the outputs along a word's path add up to its place in the table of id lists. The transducer is
written to the shared folder, fetched once per executor and memory-mapped by its workers. A batch's distinct words
walk it together, one vectorised step per byte; words outside it are merged exactly. Special tokens are never
produced: their strings in a text are ordinary text.

Defined results: null and empty texts give an empty list; texts and words of any length are taken whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import os
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import qualified, scratch_path

#: The folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Words in the transducer, and words a worker remembers beyond it.
FREQUENT_WORDS, REMEMBERED = 32_768, 300_000


@functools.cache
def word_pattern(folder: str = TOKENIZERS) -> str:
    """The published pattern that cuts a text into words."""
    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@functools.cache
def load_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte pair merging: always the adjacent pair whose joined bytes have the lowest rank, leftmost first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = end[i]
        if j >= n or end[j] - i != size:
            continue
        alive[j] = False
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
            r = ranks.get(word[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]] - i))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p : end[i]])
            if r is not None:
                heapq.heappush(heap, (r, p, end[i] - p))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Transducer:
    """A minimal acyclic automaton over bytes. Edges lie sorted by state * 256 + byte, each with its target and an
    output; a word's outputs add up to its number, the index of its ids in ``starts`` and ``ids``."""

    ARRAYS = ("keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Transducer:
        words = sorted(entries)
        known: dict[tuple, int] = {}  # final, edges -> state
        states: list[tuple] = []
        path: list[list] = [[False, []]]  # open nodes: final, edges (byte, state)

        def close(depth: int, last: bytes) -> None:
            while len(path) - 1 > depth:
                final, edges = path.pop()
                shape = (final, tuple(edges))
                state = known.get(shape)
                if state is None:
                    state = known[shape] = len(states)
                    states.append(shape)
                path[-1][1].append((last[len(path) - 1], state))

        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared, last)
            for _ in range(shared, len(word)):
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0, last)
        states.append((path[0][0], tuple(path[0][1])))
        root = len(states) - 1
        below = [0] * len(states)
        keys, targets, outputs = [], [], []
        for state, (final, edges) in enumerate(states):  # children come first
            number = int(final)
            at = 0 if state == root else state + 1  # the root is state 0
            for byte, child in edges:
                keys.append(at * 256 + byte)
                targets.append(child + 1)
                outputs.append(number)
                number += below[child]
            below[state] = number
        final = np.zeros(len(states) + 1, bool)
        for state, (f, _) in enumerate(states):
            final[0 if state == root else state + 1] = f
        order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
        lists = [entries[w] for w in words]
        return cls(
            keys=np.array(keys, np.int64)[order],
            targets=np.array(targets, np.int64)[order],
            outputs=np.array(outputs, np.int64)[order],
            final=final,
            starts=np.cumsum([0, *map(len, lists)]).astype(np.int64),
            ids=np.array([i for x in lists for i in x], np.int32),
        )

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word outside the lexicon."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n) if len(self.keys) else np.zeros(0, np.int64)
        offsets = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        result = np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            done = alive[lengths[alive] == step]
            done = done[np.asarray(self.final)[state[done]]]
            result[done] = number[done]
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            wanted = state[alive] * 256 + data[offsets[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[at] == wanted
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            number[alive] += self.outputs[at]
            step += 1
        return result

    def to_bytes(self) -> bytes:
        """One block: a header of element sizes and counts, then the arrays, each on a multiple of eight bytes."""
        parts, head = [], []
        for name in self.ARRAYS:
            a = np.ascontiguousarray(getattr(self, name))
            raw = a.tobytes()
            head += [a.dtype.itemsize, len(a)]
            parts.append(raw + b"\0" * (-len(raw) % 8))
        return np.array(head, np.int64).tobytes() + b"".join(parts)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        block = np.memmap(path, np.uint8, "r")
        head = block[: 16 * len(cls.ARRAYS)].view(np.int64)
        kinds = {"final": bool, "ids": np.int32}
        at, arrays = 16 * len(cls.ARRAYS), {}
        for k, name in enumerate(cls.ARRAYS):
            size = int(head[2 * k] * head[2 * k + 1])
            arrays[name] = block[at : at + size].view(kinds.get(name, np.int64))
            at += size + -size % 8
        return cls(**arrays)


class Encoder:
    """Encodes texts with a lexicon; words outside it are merged once and remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, lexicon: Transducer) -> None:
        self.ranks, self.find, self.lexicon = ranks, regex.compile(pattern).findall, lexicon
        self.known: dict[str, list[int]] = {}

    def _words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of the texts, all of them known now."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for words in cut for w in words if w not in known})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        numbers = self.lexicon.numbers(raw).tolist()
        starts, ids = self.lexicon.starts, self.lexicon.ids
        for word, b, number in zip(new, raw, numbers):
            known[word] = ids[starts[number] : starts[number + 1]].tolist() if number >= 0 else merge(b, self.ranks)
        return cut

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out, known = [], self.known
        for words in self._words(texts):
            one: list[int] = []
            for w in words:
                one += known[w]
            out.append(one)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        cut, known = self._words(texts), self.known
        return [sum([len(known[w]) for w in words]) for words in cut]


_encoders: dict[str, Encoder] = {}


def _worker_encoder(lexicon_file: str, ranks_file: str, pattern: str) -> Encoder:
    encoder = _encoders.get(lexicon_file)
    if encoder is None:
        lines = Path(SparkFiles.get(ranks_file)).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders.clear()
        encoder = _encoders[lexicon_file] = Encoder(ranks, pattern, Transducer.mapped(SparkFiles.get(lexicon_file)))
    return encoder


def word_counts(documents: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(word, n) over all documents, counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(find(t))
            if len(seen) > REMEMBERED:
                yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                seen = Counter()
        yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return documents.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _publish(spark: SparkSession, label: str, data: bytes) -> str:
    """Write bytes into the shared folder and have every executor fetch them; returns the file's name."""
    path = scratch_path(spark, label)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(data)
    stream.close()
    spark.sparkContext.addFile(qualified(spark, path))
    return path.rsplit("/", 1)[1]


def _published(documents: DataFrame, text_col: str, folder: str, name: str, frequent: int) -> tuple[str, str, str]:
    """The files that workers encode with, and the pattern of words; counts the words of all documents."""
    spark = documents.sparkSession
    pattern, ranks = word_pattern(folder), load_ranks(folder, name)
    counts = word_counts(documents, text_col, pattern)
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(frequent).select("word").collect()  # at most ``frequent`` rows
    words = [r.word.encode("utf-8", "surrogatepass") for r in top]
    lexicon = Transducer.compile({w: merge(w, ranks) for w in words})
    lexicon_file = _publish(spark, "lexicon", lexicon.to_bytes())
    ranks_file = _publish(spark, "ranks", (Path(folder) / f"{name}.tiktoken").read_bytes())
    return lexicon_file, ranks_file, pattern


def token_ids(documents: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, frequent: int = FREQUENT_WORDS) -> Column:
    """A column expression with the token ids of ``text_col``; building it counts the words of all documents."""
    files = _published(documents, text_col, folder, name, frequent)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(text: pa.Array) -> pa.Array:
        return pa.array(_worker_encoder(*files).encode(text.to_pylist()), pa.list_(pa.int32()))

    return ids(F.col(text_col))


def token_counts(documents: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, frequent: int = FREQUENT_WORDS) -> Column:
    """A column expression with the number of tokens of ``text_col``, without their ids."""
    files = _published(documents, text_col, folder, name, frequent)

    @F.arrow_udf(T.LongType())
    def counts(text: pa.Array) -> pa.Array:
        return pa.array(_worker_encoder(*files).count(text.to_pylist()), pa.int64())

    return counts(F.col(text_col))


def found(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", token_ids(documents).alias("ids"))
