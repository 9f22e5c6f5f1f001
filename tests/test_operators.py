import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import identity
from quillon.functions import scalars as S
from quillon.operators import facts as fx
from quillon.operators import ordered, vector, windows
from quillon.operators.graph import components

T0 = datetime(2024, 1, 1)


def loop_windows(rows, most, gap):
    out, now, prev = [], [], None
    for seq, ts, alone in rows:
        far = prev is not None and prev[1] is not None and ts is not None and (ts - prev[1]) > timedelta(minutes=gap)
        if now and (alone or prev[2] or far or len(now) == most):
            out.append(now)
            now = []
        now.append(seq)
        prev = (seq, ts, alone)
    return out + [now] if now else out


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, t = [], T0
    for k in range(200):
        t += timedelta(minutes=rng.choice([0, 5, 180, 181, -30, 400]))
        rows.append((k, None if rng.random() < 0.1 else t, rng.random() < 0.05))
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, seq long, ts timestamp, alone boolean")
    got = windows.conversation_windows(df, ["g"], ["seq"], "seq", "ts", 7, 180, F.col("alone")).orderBy("window_no").collect()
    assert [[int(i) for i in r.ids] for r in got] == loop_windows(rows, 7, 180)


def test_windows_of_a_group_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_ROWS", 30)
    rng = random.Random(9)
    rows, t = [], T0
    for k in range(200):
        t += timedelta(minutes=rng.choice([0, 5, 180, 181, 400]))
        rows.append((k, None if rng.random() < 0.1 else t, rng.random() < 0.05))
    df = spark.createDataFrame([("g", *r) for r in rows] + [("h", *r) for r in rows[:20]], "g string, seq long, ts timestamp, alone boolean")
    got = windows.conversation_windows(df, ["g"], ["seq"], "seq", "ts", 7, 180, F.col("alone")).orderBy("g", "window_no").collect()
    assert [[int(i) for i in r.ids] for r in got if r.g == "g"] == loop_windows(rows, 7, 180)
    assert [[int(i) for i in r.ids] for r in got if r.g == "h"] == loop_windows(rows[:20], 7, 180)
    numbers = ordered.with_number(df.where("g = 'g'").select((-F.col("seq")).alias("s")), ["s"], "n", part_rows=20).collect()
    assert all(r.n == r.s + 200 for r in numbers) and len(numbers) == 200
    assert ordered.with_number(df.limit(0), ["seq"], "n").count() == 0


def test_round_robin_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), rng.randrange(5)) for k in range(40)]
    got = [r.seq for r in windows.round_robin(spark.createDataFrame(rows, "seq long, month string, score long"), "month", "score", "seq", 15).collect()]
    left = {m: sorted((r for r in rows if r[1] == m), key=lambda r: (-r[2], r[0])) for m in "abc"}
    want = []
    while len(want) < 15 and any(left.values()):
        for m in sorted(left):
            if left[m] and len(want) < 15:
                want.append(left[m].pop(0)[0])
    assert got == want


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"v{rng.randrange(150)}", f"v{rng.randrange(150)}") for _ in range(110)] + [("hub", f"h{k}") for k in range(60)] + [(None, "x"), ("lone", "lone")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in parent}


def test_components_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(f"v{k}", f"v{k + 1}") for k in range(20)], "a string, b string").mapInArrow(counted, "a string, b string")
    assert {r.component for r in components(edges).collect()} == {"v0"} and read.value == 20


def test_face_clusters_and_search(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[:20] += 4
    rows = [(int(k), [float(x) for x in v[k]]) for k in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "seq long, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = 1 - u @ u.T <= 0.1
    label, want, n = {}, [], 0
    for k in range(60):
        if k not in label and near[k].sum() > 1:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += np.flatnonzero(near[x]).tolist()
            n += 1
        want.append(label.get(k, -1))
    got = {r.seq: r.label for r in vector.face_clusters(df, 0.1).collect()}
    assert [got[k] for k in range(60)] == want and got[60] == -1
    top = [r.id for r in vector.search(df.withColumnRenamed("seq", "id"), [float(x) for x in v[3]], 62).collect()]
    assert top[0] == 3 and top[-1] == 60
    batch = vector.nearest_batch(df.where("seq < 5").withColumnRenamed("seq", "q"), df.withColumnRenamed("seq", "r"), 4, "q", "r").collect()
    for r in batch:
        best = sorted(range(60), key=lambda j: (-round(float(u[r.q] @ u[j]), 6), j))[:4]
        assert best[r.rank - 1] == r.r


def test_identities(spark):
    df = spark.createDataFrame([("s", None, datetime(2025, 1, 15, 10, 32), None, "", "p.jpg"), ("s", "t", datetime(2025, 1, 15, 10, 32, 0, 5), "x", "y", "p.jpg")], "a string, b string, c timestamp, d string, e string, f string")
    got = [r[0] for r in df.select(identity.item_id(*(F.col(c) for c in "abcdef"))).collect()]
    import hashlib

    want = [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("s||2025-01-15T10:32:00+00:00||p.jpg", "s|t|2025-01-15T10:32:00.000005+00:00|x|y")]
    assert got == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.utf8_read_as_latin1(lit("Gr\u00c3\u00b6\u00c3\u009fe"))) == "Größe" and one(spark, S.utf8_read_as_latin1(lit("é"))) == "é" and one(spark, S.utf8_read_as_latin1(lit("€"))) == "€"
    assert one(spark, S.normalize_name(lit("  Ａna-Lu_B. 🎉 STRASSE ß"))) == "ana lu b strasse ss"
    assert one(spark, S.prefix_related(lit("ana b"), lit("an c"))) and not one(spark, S.prefix_related(lit(""), lit("an")))
    assert one(spark, S.first_date(lit("about 2024-01-02/2024-02-03"))) == "2024-01-02" and one(spark, S.first_date(lit("2024"))) is None
    assert one(spark, S.extract_section(lit("## One\na\nb\n\n## Two\nc"), lit("one"))) == "a\nb"
    assert one(spark, S.apple_timestamp(lit(0))) is None and one(spark, S.apple_timestamp(lit(700000001 * 10**9))) == one(spark, S.apple_timestamp(lit(700000001)))
    assert one(spark, S.whatsapp_timestamp(lit(0.5))) == datetime(2001, 1, 1, 0, 0, 0, 500000)
    for path, bad in (("/a", True), ("~/a", True), ("C:\\a", True), ("a\\..\\b", True), ("a/..b", False), ("a/b.jpg", False)):
        assert one(spark, S.unsafe_media_path(lit(path))) is bad
    assert one(spark, S.dms_to_decimal(lit(10.0), lit(30.0), lit(36.0), lit("s"))) == -10.51
    assert one(spark, S.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0 and one(spark, S.cosine(F.array(lit(1.0)), F.array(lit(1.0), lit(2.0)))) is None
    tags = F.create_map(lit("screenshot"), lit(0.5), lit("people"), lit(0.5), lit("event"), lit(0.2))
    assert one(spark, S.best_label(tags)) == "people" and one(spark, S.top_labels(tags, 2)) == ["people", "screenshot"] and one(spark, S.combined_score(tags)) == 0.7
    assert one(spark, S.cited_ids(lit("x [fact:ab-1] y [fact:cd]"))) == ["ab-1", "cd"]
    assert math.isclose(one(spark, S.sigmoid_score(lit(0.0), lit(2.0), lit(0.0))), 0.5) and one(spark, S.l2_normalize(F.array(lit(3.0), lit(4.0)))) == [0.6, 0.8]
    assert one(spark, S.message_text(lit(b"zzNSString\x01+\x02hi"), lit(""))) == "hi" and one(spark, S.message_text(lit(None).cast("binary"), lit("t"))) == "t"


def test_fact_readers(spark):
    rows = [("a", "event", "2024-01-05", ["e1", "e1"], T0, None), ("b", "habit", None, ["e2"], T0, T0), ("c", "event", "2023-01-01", None, T0, T0 + timedelta(1))]
    f = spark.createDataFrame(rows, "id string, kind string, happened_at string, entity_ids array<string>, created_at timestamp, invalid_at timestamp")
    assert [r.id for r in fx.as_of(f, T0).orderBy("id").collect()] == ["a", "c"]
    assert [r.id for r in fx.timeline(f, "2023-01-01", "2024-01-05", T0).collect()] == ["c", "a"]
    assert {r.entity_id: r.n for r in fx.counts_by_entity(f).collect()} == {"e1": 2, "e2": 1}
    assert fx.of_kinds(f, []).count() == 3 and [r.id for r in fx.for_entity(f, "e2").collect()] == ["b"]
    assert fx.fact_stats(f.where("false").withColumn("confidence", F.lit(1.0))).collect()[0].asDict() == {"kind": None, "total": 0, "mean_confidence": None, "is_total": 1}
