import random
from datetime import datetime, timedelta

from quillon.operators import orphans as O

T0 = datetime(2024, 1, 31, 12)
U = "12345678-9abc-def0-1234-56789abcdef0"
FACTS = "id string, created_at timestamp_ntz, provenance array<string>, entity_ids array<string>, key string, present string, statement string"
ITEMS, ENTITIES, TOMBS = "id string, ingested_at timestamp_ntz", "id string, created_at timestamp_ntz", "table_name string, record_key string"


def run(spark, facts, items, entities, tombs):
    dfs = [spark.createDataFrame(r, s) for r, s in ((facts, FACTS), (items, ITEMS), (entities, ENTITIES), (tombs, TOMBS))]
    return {(r.ref_table, r.period, r.fact_id, r.ref_id, r.state) for r in O.orphan_references(*dfs).collect()}


def test_states_and_edges(spark):
    facts = [
        ("f1", T0, ["a", " ", "", None, "b", "b", "c"], [U.upper(), "{" + U + "}", "urn:uuid:" + U, U.replace("-", "")], "x", "y", "s"),
        ("f1", T0, ["a", "b", "c"], None, "x", "y", "s"),
        ("f2", None, ["d", "late"], ["no-uuid"], None, None, None),
        (None, T0, ["zzz"], None, None, None, None),
        ("f3", T0, None, None, None, None, None),
        ("f4", T0, ["L" * 5000, "M" * 5000], None, None, None, None),
    ]
    items = [("a", T0 - timedelta(1)), ("a", T0 + timedelta(1)), ("late", T0 + timedelta(9)), ("c", T0 + timedelta(seconds=1)), (None, T0), ("L" * 5000, T0)]
    got = run(spark, facts, items, [(U, T0)], [("raw_items", "b"), ("entities", "d"), ("raw_items", "c"), (None, None)])
    assert got == {
        ("raw_items", "2024-01", "f1", "b", "deleted"), ("raw_items", "2024-01", "f1", "c", "late"), ("raw_items", None, "f2", "d", "missing"),
        ("entities", None, "f2", "no-uuid", "missing"), ("raw_items", "2024-01", "f4", "M" * 5000, "missing"),
    }


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == set()
    assert run(spark, [("f", T0, ["a"], None, None, None, None)], [], [], []) == {("raw_items", "2024-01", "f", "a", "missing")}


def test_many_ranges_and_a_hot_key_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_KEYS", 40)
    monkeypatch.setattr(O, "BATCH", 100)
    rng = random.Random(3)
    items = [(f"{k:04x}", T0 + timedelta(hours=rng.randrange(-50, 50))) for k in range(400)]
    facts = [(f"f{k}", T0, [f"{rng.randrange(600):04x}" if rng.random() < 0.6 else "0010" for _ in range(3)] + ["hot"], None, None, None, None) for k in range(500)]
    first = dict(items)
    want = {("raw_items", "2024-01", f[0], p, "missing" if p not in first else "late") for f in facts for p in f[2] if p not in first or first[p] > T0}
    assert run(spark, facts, items, [], []) == want
    report = O.orphans_by_period(O.orphan_references(*[spark.createDataFrame(r, s) for r, s in ((facts, FACTS), (items, ITEMS), ([], ENTITIES), ([], TOMBS))])).collect()
    assert sum(r.n_refs for r in report) == len(want)
