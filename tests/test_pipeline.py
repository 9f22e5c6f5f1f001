import io
import json
import random
import re
import threading
import urllib.error
import urllib.request
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from http.server import HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon.cli import Settings, evaluate_answers, evaluate_extraction, run_pipeline
from quillon.models.offline import BagEmbedder, Models, backend
from quillon.operators import answer, evals
from quillon.operators import facts as fx
from quillon.operators.extract import attempt, counters, extract, flattened, window_transcripts
from quillon.operators.profile import render, synthesize
from quillon.operators.resolve import FLOOR, replay
from quillon.operators.stats import append_run, last_run, stats
from quillon.operators.store import Store
from quillon.serve import handler, serve_tools
from quillon.sources.dispatch import read_corpus
from quillon.streaming.ingest import extract_new_windows, first_deliveries, ingest, session_counts

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
CHAT = "".join(f"1/{k}/24, 10:00 AM - {s}: {t}\n" for k, (s, t) in enumerate((("Ana", "Cleo likes green tea."), ("Bo", "Cleo visited Norvik."), ("Ana", "nothing"), ("Bo", "Cleo likes green tea.")), 1))


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "c" / "whatsapp").mkdir(parents=True)
    (tmp_path / "c" / "whatsapp" / "x.txt").write_text(CHAT)
    return str(tmp_path / "c")


def facts(spark, rows):
    return spark.createDataFrame(rows, "seq long, kind string, statement string, confidence double")


def test_store_facts_history_and_updates(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    ids = s.add_facts(facts(spark, [(1, "event", "a", 0.5), (2, "habit", "a", 0.7), (3, "habit", "b", 0.7)]), NOW)
    got = {r.seq: r.id for r in ids.collect()}
    assert got[1] == got[2] != got[3]
    assert {(r.kind, r.statement) for r in s.read("facts").collect()} == {("event", "a"), ("habit", "b")}
    s.add_facts(facts(spark, [(9, "place", "b", 0.1)]), NOW)
    assert s.read("fact_history").count() == 2 and s.read("facts").count() == 2
    s.update_facts(spark.createDataFrame([(got[1], 0.25, None)], "id string, confidence float, invalid_at timestamp"), NOW)
    s.update_facts(spark.createDataFrame([(got[1], NOW)], "id string, invalid_at timestamp"), NOW)
    s.update_facts(spark.createDataFrame([(got[1], None)], "id string, invalid_at timestamp"), NOW)
    row = s.read("facts").where(F.col("id") == got[1]).first()
    assert row.confidence == 0.25 and row.invalid_at == NOW.replace(tzinfo=None) and row.statement == "a"
    assert {r.event: r.n for r in fx.history_counts(s.read("fact_history")).collect()} == {"ADD": 2, "UPDATE": 1, "EXPIRE": 1}
    last = s.read("fact_history").orderBy(F.desc("id")).first()
    assert json.loads(last.prev)["statement"] == "a" and set(json.loads(last.next)) == {"invalid_at"}
    with pytest.raises(ValueError):
        s.update_facts(spark.createDataFrame([("x", "y")], "id string, statement string"), NOW)
    with pytest.raises(KeyError):
        s.update_facts(spark.createDataFrame([("x", 0.5)], "id string, confidence float"), NOW)
    at = fx.as_of(s.read("facts"), NOW.replace(tzinfo=None))
    assert [r.statement for r in at.collect()] == ["b"]
    assert fx.by_prefix(s.read("facts"), got[3][:8]).first().statement == "b"


def test_store_entities_proposals_windows(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    e = spark.createDataFrame([(1, "Ana", "person", [1.0]), (2, "Ana", "person", [2.0]), (3, "ana", "person", [3.0])], "seq long, name string, kind string, embedding array<float>")
    ids = {r.name: r.id for r in s.upsert_entities(e, NOW).collect()}
    s.upsert_entities(e, NOW)
    assert s.read("entities").count() == 2 and s.read("entities").where("name = 'Ana'").first().embedding == [1.0]
    s.add_aliases(spark.createDataFrame([(ids["Ana"], "Annie"), (ids["Ana"], "Annie")], "entity_id string, alias string"))
    s.add_aliases(spark.createDataFrame([(ids["Ana"], "Annie")], "entity_id string, alias string"))
    assert s.find_by_alias("Annie").first().aliases == ["Annie"]
    cleo = s.label_face_cluster(3, "Cleo", NOW)
    assert s.find_by_alias("face:3").first().id == cleo
    s.add_proposals(spark.createDataFrame([("An", ids["Ana"], 0.5)], "mention string, entity_id string, score double"), NOW)
    p = fx.pending_proposals(s.read("merge_proposals"), s.read("entities")).first()
    assert p.entity_name == "Ana" and fx.confirm_queue(s.read("merge_proposals")).first().pending == 1
    s.resolve_proposal(p.id, True)
    assert fx.confirm_queue(s.read("merge_proposals")).first().pending == 0 and s.find_by_alias("An").count() == 0
    w = spark.createDataFrame([("h1",), ("h2",)], "window_hash string")
    assert s.mark_windows(w, "gave_up", NOW) == 2 and s.mark_windows(w, "extracted", NOW) == 0
    assert s.pending_windows(w).count() == 0 and s.clear_given_up() == 2 and s.pending_windows(w).count() == 2
    s.save_profile("one", 1, NOW)
    s.save_profile("two", 2, NOW + timedelta(seconds=1))
    assert s.latest_profile().first().body == "two"


def test_attempt_loop():
    seen = []

    def model(prompt, escalated):
        seen.append((escalated, "not usable" in prompt))
        if len(seen) < 3:
            return {"facts": [{"kind": "nonsense", "statement": "x"}]}
        return {"facts": [], "notes": "n"}

    done = attempt("t", model)
    assert done["attempt"] == 3 and done["facts"] == [] and seen == [(False, False), (False, True), (True, True)]

    def broken(prompt, escalated):
        raise RuntimeError("down")

    assert attempt("t", broken)["facts"] is None and "down" in attempt("t", broken)["last_error"]


def test_extract_counters(spark):
    w = spark.createDataFrame([("g", "h1", ["a"], "fail"), ("g", "h2", ["b", "c"], "ok")], "source_group string, window_hash string, provenance array<string>, transcript string")

    def model(prompt, escalated):
        if "fail" in prompt:
            raise ValueError("no")
        return {"facts": [{"kind": "event", "statement": "s", "confidence": 0.5, "subjects": ["A"]}]}

    r = extract(w, model).persist()
    c = counters(r).first()
    assert (c.windows, c.retries, c.escalations, c.give_ups, c.facts) == (2, 2, 1, 1, 1)
    assert flattened(r).first().provenance == ["b", "c"]


def test_resolution_tiers():
    ana, ann = ("1", "Ana Oru", ("annie",), 0.9), ("2", "Ann Bel", (), 0.8)
    no = lambda m, c: {"same": False, "confidence": 0.0}
    yes = lambda m, c: {"same": True, "confidence": 0.7}
    sure = lambda m, c: {"same": True, "confidence": 0.9 if c == "Ann Bel" else 0.86}
    assert replay(["Annie"], {"Annie": [ana, ann]}, {}, {}, no).resolved == {"Annie": "1"}
    assert replay(["An"], {"An": [ana]}, {}, {}, no).resolved == {"An": "1"}
    both = replay(["An"], {"An": [ana, ann]}, {}, {}, yes)
    assert both.resolved == {} and both.proposals == [("An", "1", 0.7), ("An", "2", 0.7)]
    assert replay(["An"], {"An": [ana, ann]}, {}, {}, sure).resolved == {"An": "2"}
    made = replay(["Zed", "Zed Two"], {}, {("Zed Two", "Zed"): 0.8}, {}, no)
    assert made.created == ["Zed"] and made.resolved["Zed Two"] == made.resolved["Zed"]
    assert replay(["Zed"], {"Zed": [("1", "Ana", (), FLOOR - 0.01)]}, {}, {}, no, create=False).resolved == {}
    assert replay(["face:1", "face:2"], {}, {}, {"face:1": "9"}, no).resolved == {"face:1": "9"}


def test_pipeline_rerun_and_tools(spark, tmp_path, corpus):
    s, models = Store(spark, str(tmp_path / "store")), Models()
    settings = Settings(store=str(tmp_path / "store"), corpus=corpus, source_tz="UTC")
    first = run_pipeline(s, settings, models)
    assert first["facts_created"] == 3 and first["facts_added"] == 2 and first["dedup_hits"] == 1 and first["mentions"] == 1
    again = run_pipeline(s, settings, models)
    assert again["windows_processed"] == 0 and again["windows_skipped_extracted"] == 4 and again["facts_added"] == 0
    assert stats(s, settings.runs)["last_run"]["windows_processed"] == 0
    assert answer.list_people(s)[0]["name"] == "Cleo" and answer.list_people(s)[0]["fact_count"] == 2
    a = answer.answer_question(s, models, "What does Cleo like?")
    assert len(a["facts"]) == 2 and "[fact:" in a["answer"]
    assert answer.get_person(s, models, "Cleo")["found"] and answer.get_person(s, models, "Nobody Else") == {"found": False}
    assert answer.get_profile(s).startswith("## Timeline") and "green tea" in answer.get_profile(s, "preferences")
    assert [m["statement"] for m in answer.search_memories(s, models, "green tea", ["Cleo"], limit=1)] == ["Cleo likes green tea"]
    assert answer.query_timeline(s) == []
    out = io.StringIO()
    serve_tools(s, models, io.StringIO('{"tool": "list_people"}\n{"tool": "none"}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0]["result"][0]["name"] == "Cleo" and "error" in replies[1]
    server = HTTPServer(("127.0.0.1", 0), handler(s, models))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    fact = a["facts"][0]["id"]
    assert json.loads(urllib.request.urlopen(f"{base}/api/fact/{fact[:8]}").read())["id"] == fact
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/api/fact/zzzz")
    server.shutdown()
    e = evaluate_extraction(s, settings, models, [{"kind": "preference", "statement": "Cleo likes green tea", "must_match": ["green"]}, {"kind": "place", "statement": "x", "must_match": ["x"]}])
    assert e["matched"] == 1 and e["recall"] == 0.5 and e["misses"] == ["x"]
    assert evaluate_answers(s, models, [])["faithfulness"] == 0.0


def test_give_up_and_retry(spark, tmp_path, corpus):
    s = Store(spark, str(tmp_path / "store"))
    items = read_corpus(spark, corpus, "UTC").persist()

    def down(prompt, escalated):
        raise RuntimeError("down")

    assert extract_new_windows(items, s, down, now=NOW)["facts"] == 0
    assert extract_new_windows(items, s, Models().extractor, now=NOW)["windows"] == 0
    assert extract_new_windows(items, s, Models().extractor, retry_failed=True, now=NOW)["facts"] == 3


def test_profile_render_and_staleness(spark, tmp_path):
    text = render({"Habits": [("abcdefgh-1", "Runs daily."), ("12345678-1", "Swims")]}, lambda x: ["", "Swims well.."])
    assert text == "## Habits\nRuns daily [fact:abcdefgh].\nSwims well [fact:12345678]."
    s = Store(spark, str(tmp_path))
    s.add_facts(facts(spark, [(1, "habit", "a", 0.5)]), NOW)
    assert synthesize(s, lambda x: x, NOW) and not synthesize(s, lambda x: x, NOW)


def test_run_log_and_backend(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    assert last_run(spark, path) is None
    for k in (1, 2):
        append_run(spark, path, {"timestamp": f"2024-01-0{k}", "items": k})
    assert last_run(spark, path)["items"] == 2
    assert backend("text") == "offline" and backend("text", "k") == "hosted"
    monkeypatch.setenv("QUILLON_TEXT_BACKEND", "hosted")
    with pytest.raises(ValueError):
        backend("text")
    with pytest.raises(ValueError):
        backend("sound")


def test_greedy_eval(spark):
    gold = [{"seq": 1, "kind": "event", "must_match": ["a"]}, {"seq": 2, "kind": "event", "must_match": ["a", "B"]}]
    got = [{"seq": 1, "kind": "event", "statement": "a b"}, {"seq": 2, "kind": "event", "statement": "a"}]
    assert evals.greedy_match(got, gold) == [(1, 1)]
    vectors = [dict(got[0], embedding=[1.0, 0.0]), dict(got[1], embedding=[0.0, 1.0])]
    assert evals.greedy_match(vectors, [dict(gold[0], embedding=[0.0, 1.0])]) == [(1, 2)]


def test_greedy_eval_walks_once(monkeypatch):
    """Every pair of patterns and statement is searched once, with the results of the plain search of all for all."""
    rng = random.Random(3)
    searched = []

    class Pattern:
        def __init__(self, p, flags):
            self.p = re.compile(p, flags)

        def search(self, text):
            searched.append(text)
            return self.p.search(text)

    def plain(got, gold):
        used, out = set(), []
        for g in sorted(gold, key=lambda r: r["seq"]):
            for x in sorted(got, key=lambda r: r["seq"]):
                near = g["embedding"] is None or x["embedding"] is None or g["embedding"] == x["embedding"]
                if x["seq"] not in used and x["kind"] == g["kind"] and near and all(re.search(p, x["statement"] or "", re.IGNORECASE) for p in g["must_match"]):
                    used.add(x["seq"])
                    out.append((g["seq"], x["seq"]))
                    break
        return out

    def vector():
        return rng.choice([None, [1.0, 0.0], [0.0, 1.0]])

    got = [{"seq": k // 2 if k < 40 else k, "kind": rng.choice("kl"), "statement": rng.choice(["A one", "a two", "b one", "", None]), "embedding": vector()} for k in range(300)]
    gold = [{"seq": k, "kind": rng.choice("klm"), "must_match": rng.choice([["^a"], ["one"], ["a", "one"], [], ["c"]]), "embedding": vector()} for k in range(300)]
    rng.shuffle(gold)
    want = plain(got, gold)
    with monkeypatch.context() as m:
        m.setattr(evals, "re", SimpleNamespace(compile=Pattern, IGNORECASE=re.IGNORECASE, Pattern=re.Pattern))
        assert evals.greedy_match(got, gold) == want
    assert len(searched) <= 5 * 4 * 2  # lists of patterns, statements, patterns in a list


def test_streaming(spark, tmp_path, corpus):
    s = Store(spark, str(tmp_path / "store"))
    items = read_corpus(spark, corpus, "UTC")
    items.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
        items.write.mode("append").parquet(str(tmp_path / "in"))
    assert s.read("raw_items").count() == 4
    base = datetime(2024, 1, 1)
    events = [("u", base + timedelta(minutes=m)) for m in (0, 180, 361)]
    spark.createDataFrame(events, "k string, ts timestamp").write.parquet(str(tmp_path / "ev"))
    spark.createDataFrame([("z", base + timedelta(days=9))], "k string, ts timestamp").write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "ev"))
    q = session_counts(stream, "k", "ts").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert first_deliveries(stream.withColumnRenamed("k", "id"), ts="ts").isStreaming
    assert sorted(r.n for r in spark.table("sessions").where("k = 'u'").collect()) in ([1, 2], [])


def test_embedder_and_transcript(spark):
    e = BagEmbedder(8)
    assert abs(sum(x * x for x in e.embed_query("a b c")) - 1) < 1e-9 and e.embed_query("") == [0.0] * 8
    items = spark.createDataFrame([("i1", "sms", NOW, None, "hi", None, True, '{"ocr_lines":["x","y"],"vision_tags":["pet"]}', "g", 1)], "id string, source string, ts timestamp, sender string, text string, media_path string, is_system boolean, meta string, source_group string, seq long")
    assert window_transcripts(items).first().transcript == "[SYSTEM @ 2024-05-01T12:00:00]: hi OCR: x | y tags: pet"
    assert replace(Models(), embedder=e).embedder.dims == 8


def test_changes_are_sets_that_fold(spark, tmp_path, monkeypatch):
    """A change writes its rows alone, the latest one counts, sets fold into a snapshot, and old snapshots go."""
    from quillon.operators import store as st

    monkeypatch.setattr(st, "MOST_CHANGES", 3)
    s = st.Store(spark, str(tmp_path / "s"))
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    s.add_facts(spark.createDataFrame([(k, "event", f"s{k}", 0.5) for k in range(6)], "seq long, kind string, statement string, confidence double"), now)
    ids = {r.statement: r.id for r in s.read("facts").collect()}
    for k in range(7):
        s.update_facts(spark.createDataFrame([(ids["s1"], f"k{k}"), (ids[f"s{k % 6}"], f"k{k}")], "id string, kind string").distinct(), datetime(2024, 1, 2 + k, tzinfo=timezone.utc))
        assert {r.statement: r.kind for r in s.read("facts").collect()}["s1"] == f"k{k}" and s.read("facts").count() == 6
        s.add_facts(spark.createDataFrame([(0, "event", "s1", 0.1)], "seq long, kind string, statement string, confidence double"), now)
    names = sorted(p.name for p in (tmp_path / "s" / "facts").iterdir() if not p.name.startswith("."))
    assert names == ["CURRENT", "v2", "v2-change-000000", "v2-change-000001", "v2-change-000002", "v3", "v3-change-000000"]
    history = s.read("fact_history").where("event = 'UPDATE'").count()
    s.update_facts(spark.createDataFrame([(ids["s1"], "k6")], "id string, kind string"), datetime(2024, 1, 8, tzinfo=timezone.utc))
    assert s.read("fact_history").where("event = 'UPDATE'").count() == history  # repeated after a failure: told once
