"""Evaluation: greedy matching of extracted facts to gold, scores, and means of answer metrics."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Similarity from which an extracted statement may stand for a gold one.
FLOOR = 0.6


def load_rows(path: str) -> list[dict]:
    """The entries of a YAML or JSON list; a mapping is searched for its one list."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need the yaml package; write the list as JSON") from e
        rows = yaml.safe_load(text)
    else:
        rows = json.loads(text)
    if isinstance(rows, dict):
        rows = next((v for v in rows.values() if isinstance(v, list)), [])
    return rows or []


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """(seq, kind, statement, subjects, must_match): gold facts, written by hand and few."""
    rows = [(k, g["kind"], g["statement"], list(g.get("subjects") or []), [str(p) for p in g["must_match"]]) for k, g in enumerate(load_rows(path))]
    return spark.createDataFrame(rows, "seq long, kind string, statement string, subjects array<string>, must_match array<string>")


def load_questions(path: str) -> list[dict]:
    """(question, reference, kinds) of the questions of an answer evaluation."""
    return [{"question": q["question"], "reference": q.get("reference"), "kinds": list(q.get("kinds") or [])} for q in load_rows(path)]


def _cosine(a, b) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / size) if size else 0.0


def greedy_match(extracted: list[dict], gold: list[dict], floor: float = FLOOR) -> list[tuple[int, int]]:
    """(gold seq, extracted seq): in gold order, each gold fact takes the first unused extracted fact of its kind
    that all its patterns hit, any case, and that is similar enough; without vectors on either side similarity is
    not asked. Gold facts of one kind with the same patterns and vector walk the extracted facts once between them: what
    one of them passed over, used or not fitting, fits none of the later ones. A statement is searched once for a list
    of patterns."""
    of_kind: dict[str, list[dict]] = {}
    for x in sorted(extracted, key=lambda r: r["seq"]):
        of_kind.setdefault(x["kind"], []).append(x)
    used: set[int] = set()
    searched: dict[tuple, tuple[list[re.Pattern], dict[str, bool]]] = {}
    walks: dict[tuple, Iterator[dict]] = {}
    pairs = []
    for g in sorted(gold, key=lambda r: r["seq"]):
        must, va = tuple(g["must_match"]), g.get("embedding")
        if must not in searched:
            searched[must] = ([re.compile(p, re.IGNORECASE) for p in must], {})
        patterns, hit = searched[must]
        for x in walks.setdefault((g["kind"], must, None if va is None else tuple(va)), iter(of_kind.get(g["kind"], ()))):
            if x["seq"] in used:
                continue
            statement = x["statement"] or ""
            if statement not in hit:
                hit[statement] = all(p.search(statement) for p in patterns)
            vb = x.get("embedding")
            if not hit[statement] or (va is not None and vb is not None and _cosine(va, vb) < floor):
                continue
            used.add(x["seq"])
            pairs.append((g["seq"], x["seq"]))
            break
    return pairs


def match(extracted: DataFrame, gold: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(kind, gold_seq, extracted_seq) of the greedy matching. Matches never cross kinds, so each kind is one
    group; gold sets are written by hand and small."""
    asked = ("seq", "kind", "statement", "must_match", "embedding")
    a, b = (df.select(*(c for c in asked if c in df.columns), F.lit(side).alias("side")) for df, side in ((extracted, "x"), (gold, "g")))
    both = a.unionByName(b, allowMissingColumns=True)

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs = greedy_match([r for r in rows if r["side"] == "x"], [r for r in rows if r["side"] == "g"], floor)
        kinds = [rows[0]["kind"]] * len(pairs)
        return pa.table([pa.array(kinds, pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["kind", "gold_seq", "extracted_seq"])

    return both.groupBy("kind").applyInArrow(one, "kind string, gold_seq long, extracted_seq long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scores(extracted: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, gold, extracted, matched, precision, recall, f1) per kind."""
    parts = [df.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for df, w in ((gold, "gold"), (extracted, "extracted"), (pairs, "matched"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wide = every.groupBy("kind").agg(*(F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("gold", "extracted", "matched")))
    p, r = _ratio(F.col("matched"), F.col("extracted")), _ratio(F.col("matched"), F.col("gold"))
    scored = wide.withColumn("precision", p).withColumn("recall", r)
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def misses(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    return gold.join(pairs.select(F.col("gold_seq").alias("seq")), "seq", "left_anti")


def spurious(extracted: DataFrame, pairs: DataFrame) -> DataFrame:
    return extracted.join(pairs.select(F.col("extracted_seq").alias("seq")), "seq", "left_anti")


# The metrics of an answer and the least mean that passes.
THRESHOLDS = {"faithfulness": 0.85, "relevancy": 0.80, "context_precision": 0.70}


def metric_means(rows: DataFrame) -> DataFrame:
    """One row with the mean of each metric, 0 without questions, and whether all pass."""
    means = rows.agg(*(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in THRESHOLDS))
    ok = F.lit(True)
    for m, least in THRESHOLDS.items():
        ok = ok & (F.col(m) >= least)
    return means.withColumn("passed", ok)
