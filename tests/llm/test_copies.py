import random
from collections import defaultdict

from quillon.llm import copies as C

SCHEMA = "id string, statement string, key string, n long"


def test_canonical():
    same = ["Ana Oru runs 8.5 km, daily.", "ANA  ORU\nruns 8.5 km daily", "“ana oru (runs 8.5 km) daily…”", "ana oru runs 8.5 km - daily!"]
    assert len({C.canonical(s) for s in same}) == 1
    assert C.canonical("runs 85 km") != C.canonical("runs 8.5 km") and C.canonical("a b") != C.canonical("b a")
    assert C.canonical("Straße") == C.canonical("STRASSE") and C.canonical("é") == C.canonical("é")
    fields = ["who: Ana; what: concert; when: 2018-01-02", "WHAT=Concert; when=2018-01-02; who=ANA", '{"when":"2018-01-02", "who":"Ana","what":"concert"}', "Who: Ana | When: 2018-01-02 | What: concert.", "what: concert\nwho: Ana\nwhen: 2018-01-02"]
    assert len({C.canonical(s) for s in fields}) == 1
    assert C.canonical("who: Ana; with: Bo") != C.canonical("who: Bo; with: Ana")
    assert C.canonical("who: Ana; when: 2018-01-02") != C.canonical("who: Ana; when: 20180102")
    assert C.canonical(None) == C.canonical(" ") == C.canonical("...") == ""


def brute(rows):
    groups = defaultdict(set)
    for i, s, *_ in rows:
        if i is not None and C.canonical(s):
            groups[C.canonical(s)].add(i)
    return {(min(g), len(g)) for g in groups.values()}


def run(spark, rows, fits):
    return {(r.keep_id, r.copies) for r in C.collapse(spark.createDataFrame(rows, SCHEMA), fits=fits).collect()}


def test_collapse_against_brute_force(spark):
    rng = random.Random(1)
    texts = [f"{rng.choice(['Common prefix of all ', ''])}{rng.randrange(120)} {'x' * rng.randrange(3)}" for _ in range(400)]
    rows = [(f"i{k}", rng.choice([t, t.upper(), f" {t}."]), "q", 1) for k, t in enumerate(texts)]
    rows += [(f"h{k}", "hot statement!", "q", 1) for k in range(200)]
    rows += [rows[0], rows[0], (None, "a", "q", 1), ("n1", None, "q", 1), ("n2", "", "q", 1), ("n3", "?!", "q", 1), ("L1", "long " * 20_000, "q", 1), ("L2", "LONG " * 20_000, "q", 1)]
    want = brute(rows)
    assert run(spark, rows, 200_000) == want
    assert run(spark, rows, 20) == want
    assert {(r.keep_id, r.copies) for r in C.found(spark.createDataFrame(rows, SCHEMA)).collect()} == {w for w in want if w[1] > 1}


def test_empty(spark):
    assert run(spark, [], 10) == set()


def test_trie_bursts():
    trie = C.BurstTrie()
    trie.BURST if hasattr(trie, "BURST") else None
    keys = [f"abcd{k:06d}".encode() for k in range(6000)] + [b"", b"a", b"abcd"]
    for k in keys * 2:
        trie.add(k, 1, k.decode())
    ends = list(trie.counters())
    assert len(ends) == len(keys) and all(n == 2 for n, _ in ends)
