from collections import defaultdict
from pathlib import Path

import pytest

from quillon.llm import packing as P
from quillon.llm.tokens import TOKENIZERS

pytestmark = pytest.mark.skipif(not (Path(TOKENIZERS) / "byte_bpe_50k.tiktoken").exists(), reason="vocabulary files are not here")


def run(spark, texts, budgets, **k):
    d = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    b = spark.createDataFrame([(f"b{c}", "byte_bpe_50k", c) for c in budgets], "budget_name string, tokenizer string, capacity_tokens long")
    return P.containers(d, b, **k)


def test_whole_within_capacity_and_little_unused(spark):
    topics = ["garden flowers and roses", "train station platform", "violin concert music", "cake flour sugar"]
    texts = [f"{topics[k % 4]} number {k} " * (1 + k % 9) for k in range(200)] + ["", None, "long word " * 400]
    df = run(spark, texts, [64, 256, None, 0], shard_docs=80)
    rows = df.collect()
    for capacity in (64, 256):
        filled, parts, size = defaultdict(int), defaultdict(list), defaultdict(int)
        for r in rows:
            if r.capacity_tokens == capacity:
                filled[r.container] += r.n_tokens
                parts[r.doc_id].append((r.part, r.first_token, r.n_tokens))
                size[r.doc_id] += r.n_tokens
        assert max(filled.values()) <= capacity and set(parts) == set(range(len(texts)))
        for doc, p in parts.items():
            assert len(p) == 1 or size[doc] > capacity
            at = 0
            for _, first, n in sorted(p):
                assert first == at
                at += n
        assert sum(filled.values()) / (len(filled) * capacity) > 0.9
    report = {r.budget_name: r for r in P.fill_report(df).collect()}
    assert report["b64"].tokens == report["b256"].tokens and set(report) == {"b64", "b256"}


def test_neighbours_come_together(spark):
    texts = ["violin concert orchestra melody"] * 3 + ["carrot potato onion soup"] * 3
    rows = run(spark, texts, [16]).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.container].add(r.doc_id // 3)
    assert all(len(v) == 1 for v in by.values() if len(v)) or len(by) <= 3


def test_empty(spark):
    assert run(spark, [], [64]).count() == 0 and run(spark, ["a"], []).count() == 0


def test_scores_are_bm25(spark):
    """Lists and wide rows give the same scores as the formula, before and after used documents leave the lists."""
    import numpy as np

    rng = np.random.default_rng(3)
    terms = [np.unique(rng.choice(60, rng.integers(0, 12)) ** 2 % 97) for _ in range(80)]
    counts = [rng.integers(1, 4, len(t)) for t in terms]
    lengths = np.array([c.sum() for c in counts], float)
    df = np.zeros(P.TERMS, np.int32)
    for t in terms:
        df[t] += 1
    view = P.Index(terms, counts, lengths, df, 80, lengths.mean()).view()

    def formula(a, b):
        tf = dict(zip(terms[b].tolist(), counts[b].tolist()))
        idf = {t: np.log(1 + (80 - df[t] + 0.5) / (df[t] + 0.5)) for t in tf}
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * lengths[b] / lengths.mean())) for t in terms[a].tolist() if t in tf)

    unused = np.ones(80, bool)
    for used in (0, 50, 70):
        unused[:used] = False
        view.compact(unused)
        for a in (0, 7, 79):
            assert np.allclose(view.scores(a), [formula(a, b) for b in view.at], atol=1e-4) and set(np.flatnonzero(unused)) <= set(view.at)


def test_neighbours_stand_in_one_shard(spark):
    topics = ["garden flowers roses soil spade", "train station platform ticket delay", "violin concert orchestra melody bow", "carrot potato onion soup broth"]
    rows = [(k, " ".join(topics[k % 4].split()[j] for j in ((k // 4) % 5, (k // 20) % 5, (k // 100) % 5)), "q") for k in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, part string")
    found, wanted = P.neighbours(d, shard_docs=1500)
    assert wanted > 0 and found / wanted >= 0.9
    one = {(r.container, r.doc_id) for r in P.containers(d, spark.createDataFrame([("b", "byte_bpe_50k", 64)], "budget_name string, tokenizer string, capacity_tokens long"), shard_docs=1500).collect()}
    again = {(r.container, r.doc_id) for r in P.containers(d.repartition(7), spark.createDataFrame([("b", "byte_bpe_50k", 64)], "budget_name string, tokenizer string, capacity_tokens long"), shard_docs=1500).collect()}
    assert one == again
