import json
from datetime import datetime, timezone

from quillon.llm import conversations as C

ITEMS = "id string, source string, ts string, sender string, body string, media_path string, is_system boolean, meta string, export_id string, us string, channel string"


def ms(k):
    return str(int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000) + k * 1000)


def row(i, t, sender, thread="t", export="e", body="hi", media=None, system=False, **meta):
    m = None if thread is None else json.dumps({"thread": thread, **meta})
    return (i, "sms", None if t is None else ms(t), sender, body, media, system, m, export, "q", "q")


def run(spark, rows, f=C.found):
    items = spark.createDataFrame(rows, ITEMS)
    exports = spark.createDataFrame([("e", "Zoë", None), ("e2", "Ann", "UTC")], "export_id string, owner string, source_tz string")
    return f(items, exports)


def found(spark, rows):
    return sorted(tuple(r) for r in run(spark, rows).collect())


def test_kept_ordered_and_roles(spark):
    rows = [
        row("b", 2, "Bo", line=2), row("a", 2, "ZoÃ«", line=1), row("a", 2, "ZoÃ«", line=1), row("c", 1, "Bo"), row("d", 3, "ME", body=None, media="x.jpg", reply_to="n"),
        row("n", None, None, system=True), row("v", 4, "Bo", body=" ​﻿\n"),
    ]
    assert found(spark, rows) == [("c", 1, "c", "contact"), ("c", 2, "a", "owner"), ("c", 3, "b", "contact"), ("c", 4, "d", "owner")]


def test_dropped(spark):
    ok = [row("a", 1, "me", "+1 23"), row("b", 2, "Bo", "+12-3")]
    assert len(found(spark, ok)) == 2
    assert found(spark, ok[:1]) == []
    assert found(spark, [row("a", 1, "Cy"), row("b", 2, "Bo")]) == []
    assert found(spark, [*ok, row("c", None, "Bo", "+123")]) == []
    assert found(spark, [*ok, row("c", 3, " ", "+123")]) == []
    assert found(spark, [*ok, row("c", 3, "Bo", "+123", reply_to="zz")]) == []
    assert len(found(spark, [*ok, row("c", 3, "Bo", "+123", reply_to="x"), row("x", None, None, "+123", system=True)])) == 3
    bad = [("p", "sms", ms(1), "me", "x", None, False, m, "e", "q", "q") for m in (None, "{'thread': 'a'}", '{"thread": "a', "[]", '{"thread": null}', '{"thread": " "}', "{}")]
    assert found(spark, bad) == [] and found(spark, []) == []


def test_a_large_thread_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 20)
    rows = [row(f"i{k:04d}", (k * 37) % 300, "me" if k % 2 else "Bo", "hot") for k in range(300)] + [row(f"j{k}", k, "me" if k % 2 else "Bo", f"t{k // 2}") for k in range(40)]
    got = found(spark, rows)
    hot = [g for g in got if g[2].startswith("i")]
    want = sorted(range(300), key=lambda k: ((k * 37) % 300, k))
    assert [g[2] for g in sorted(hot, key=lambda g: g[1])] == [f"i{k:04d}" for k in want] and len({g[0] for g in hot}) == 1
    assert len(got) == 340


def test_sessions(spark):
    rows = [row(f"a{k}", t, "me" if k % 2 else "Bo") for k, t in enumerate([0, 30, 60, 90, 500_000, 500_030])]
    s = sorted(tuple(r) for r in run(spark, rows, C.sessions).select("session", "n_turns", "replied").collect())
    assert s == [(1, 4, True), (2, 2, True)]


def test_sessions_against_brute_force(spark, monkeypatch):
    """Gaps calibrated over all gaps of the source, sessions split at them and numbered, unanswered ones dropped, also
    where a thread is spread over parts."""
    import numpy as np

    monkeypatch.setattr(C, "PART_ROWS", 15)
    rng = np.random.default_rng(2)
    threads = {f"t{n}": np.cumsum(rng.choice([5, 40, 300, 4000, 100_000], 60, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for n in range(4)}
    rows = [row(f"{t}-{k:02d}", int(s), "me" if rng.random() < 0.4 else "Bo", t) for t, at in threads.items() for k, s in enumerate(at)]
    who = {r[0]: r[3] for r in rows}
    gaps = np.sort(np.concatenate([np.diff(at) for at in threads.values()])) * 1_000_000
    marks = [gaps[int(np.ceil(q * len(gaps))) - 1] for q in (0.75, 0.99)]
    gap = min(max(int(np.sqrt(float(marks[0]) * float(marks[1]))), C.LEAST_GAP), C.MOST_GAP)
    want = set()
    for t, at in threads.items():
        number, members = 1, []
        for k, s in [*enumerate(at), (None, None)]:
            if k is None or (members and (s - at[members[-1]]) * 1_000_000 > gap):
                own = sum(who[f"{t}-{m:02d}"] == "me" for m in members)
                if 0 < own < len(members):
                    want.add((f"{t}-00", number, len(members), own, int(at[members[-1]] - at[members[0]]) * 1_000_000))
                number, members = number + 1, []
            if k is not None:
                members.append(k)
    got = {(r.conv, r.session, r.n_turns, r.n_owner, r.end_us - r.start_us) for r in run(spark, rows, C.sessions).collect()}
    assert got == want and len(want) < sum(len(at) for at in threads.values())
