"""Command line over a store: ingest, pipeline, faces, proposals, evaluation, profile, statistics, serving."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.models.offline import Models, backend
from quillon.operators import answer, evals
from quillon.operators.extract import counters, embed, extract, flattened, outcome, window_transcripts
from quillon.operators.facts import link_subjects, pending_proposals
from quillon.operators.profile import synthesize
from quillon.operators.resolve import resolve
from quillon.operators.stats import append_run, stats
from quillon.operators.store import Store
from quillon.operators.vision import enrich
from quillon.session import settle_table
from quillon.sources.dispatch import read, read_corpus
from quillon.sources.photos import ENDINGS


@dataclass(frozen=True)
class Settings:
    """Where things are; the environment sets the defaults."""

    store: str = os.environ.get("QUILLON_STORE", "quillon-store")
    corpus: str = os.environ.get("QUILLON_CORPUS", "corpus")
    source_tz: str = os.environ.get("QUILLON_SOURCE_TZ", "UTC")
    key: str | None = os.environ.get("QUILLON_MODEL_KEY")

    @property
    def runs(self) -> str:
        return f"{self.store}/runs"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(store: Store, path: str, settings: Settings) -> dict:
    return {"added": store.add_raw_items(read(store.spark, path, settings.source_tz))}


def run_pipeline(store: Store, settings: Settings, models: Models, skip_vision: bool = True, cap: int = 20, retry_failed: bool = False) -> dict:
    """Read, enrich, store, window, extract, store facts, resolve, link, profile; returns the run's record."""
    backend("text", settings.key)
    spark, began = store.spark, time.time()
    before = store.read("facts").count()
    if retry_failed:
        store.clear_given_up()
    items = read_corpus(spark, settings.corpus, settings.source_tz)
    if not skip_vision and (Path(settings.corpus) / "photos").is_dir():
        root = str(Path(settings.corpus) / "photos")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.where(F.lower("path").rlike(r"\.(" + "|".join(ENDINGS) + ")$")).select(F.element_at(F.split(F.url_decode("path"), F.lit("\\Q" + root + "/\\E")), -1).alias("path"), "content")
        photos = items.where("source = 'photo'")
        items = items.where("source <> 'photo'").unionByName(enrich(photos, files, models, cap))
    items = settle_table(items, "items")
    store.add_raw_items(items)
    windows = settle_table(window_transcripts(items), "windows")
    skipped = {r["outcome"]: r["n"] for r in store.skipped_windows(windows).collect()}
    results = settle_table(extract(store.pending_windows(windows), models.extractor), "results")
    facts = settle_table(embed(flattened(results), "statement", models.embedder), "facts")
    ids = settle_table(store.add_facts(facts, _now()), "fact-ids")
    store.mark_windows(results, outcome(), _now())
    subjects = facts.select("seq", "subjects").join(ids, "seq").select("id", "subjects")
    mentions = subjects.select(F.explode("subjects").alias("mention")).where("mention <> ''").distinct()
    resolved = resolve(store, mentions, models.embedder, models.judge, _now())
    linked = link_subjects(subjects, resolved)
    store.update_facts(settle_table(linked, "links"), _now())
    synthesize(store, models.renderer, _now())
    c = counters(results).first()
    record = {
        "timestamp": _now().isoformat(), "duration_s": round(time.time() - began, 3), "items": items.count(), "windows_processed": c["windows"], "windows_skipped_extracted": skipped.get("extracted", 0),
        "windows_skipped_gave_up": skipped.get("gave_up", 0), "facts_created": c["facts"], "facts_added": store.read("facts").count() - before, "retries": c["retries"], "escalations": c["escalations"],
        "give_ups": c["give_ups"], "mentions": mentions.count(),
    }
    record["dedup_hits"] = record["facts_created"] - record["facts_added"]
    append_run(spark, settings.runs, record)
    return record


def evaluate_extraction(store: Store, settings: Settings, models: Models, gold: list[dict]) -> dict:
    """Scores of extraction alone against gold facts (kind, statement, must_match)."""
    spark = store.spark
    results = settle_table(extract(window_transcripts(read_corpus(spark, settings.corpus, settings.source_tz)), models.extractor), "results")
    got = embed(flattened(results).drop("seq", "provenance").distinct(), "statement", models.embedder)
    got = settle_table(got.withColumn("seq", F.xxhash64("window_hash", "statement")).select("seq", "kind", "statement", "embedding"), "extracted")
    rows = spark.createDataFrame([(k, g["kind"], g["statement"], g["must_match"]) for k, g in enumerate(gold)], "seq long, kind string, statement string, must_match array<string>")
    rows = embed(rows, "statement", models.embedder)
    pairs = settle_table(evals.match(got, rows), "pairs")
    by_kind = [r.asDict() for r in evals.scores(got, rows, pairs).collect()]
    n = {k: sum(r[k] for r in by_kind) for k in ("gold", "extracted", "matched")}
    p = n["matched"] / n["extracted"] if n["extracted"] else 0.0
    r = n["matched"] / n["gold"] if n["gold"] else 0.0
    return {**n, "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "by_kind": by_kind, "misses": [x["statement"] for x in evals.misses(rows, pairs).collect()]}


def evaluate_answers(store: Store, models: Models, questions: list[dict]) -> dict:
    """Mean metrics of answers: words of the answer found in its facts, words of the question found in the answer,
    and retrieved facts of the wanted kinds. Real metrics may replace these."""
    rows = []
    for q in questions:
        facts = answer.retrieve(store, [q["question"]], models).collect()
        text = models.answerer(q["question"], "\n".join(f"[fact:{f['id']}] {f['statement']}" for f in facts))
        words, known = set(text.lower().split()), set(" ".join(f["statement"] for f in facts).lower().split())
        asked = set(q["question"].lower().split())
        kinds = set(q.get("kinds") or [])
        rows.append((len(words & known) / max(len(words), 1), len(asked & words) / max(len(asked), 1), sum(not kinds or f["kind"] in kinds for f in facts) / max(len(facts), 1)))
    df = store.spark.createDataFrame(rows, "faithfulness double, relevancy double, context_precision double")
    return evals.metric_means(df).first().asDict()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("--store", default=Settings.store)
    p.add_argument("--source-tz", default=Settings.source_tz)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("path")
    pipe = sub.add_parser("pipeline").add_subparsers(dest="action", required=True)
    for name in ("run", "retry-given-up"):
        a = pipe.add_parser(name)
        a.add_argument("--skip-vision", action="store_true")
        a.add_argument("--cap", type=int, default=20)
        a.add_argument("--corpus-dir", default=Settings.corpus)
        a.add_argument("--retry-failed", action="store_true")
    a = sub.add_parser("label-faces")
    a.add_argument("cluster", type=int)
    a.add_argument("name")
    a = sub.add_parser("resolve")
    a.add_argument("--yes", action="append", default=[])
    a.add_argument("--no", action="append", default=[])
    a = sub.add_parser("eval")
    a.add_argument("what", choices=("extraction", "rag"))
    a.add_argument("file")
    a.add_argument("--corpus-dir", default=Settings.corpus)
    sub.add_parser("profile").add_argument("action", choices=("build",))
    sub.add_parser("stats").add_argument("--json", action="store_true")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a = sub.add_parser("serve-ui")
    a.add_argument("--port", type=int, default=8765)
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings(store=args.store, source_tz=args.source_tz, corpus=getattr(args, "corpus_dir", Settings.corpus))
    models, spark = Models(), _session()
    store = Store(spark, settings.store)
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False, indent=2))
    try:
        if args.command == "ingest":
            show(ingest(store, args.path, settings))
        elif args.command == "pipeline":
            show(run_pipeline(store, settings, models, args.skip_vision, args.cap, args.retry_failed or args.action == "retry-given-up"))
        elif args.command == "label-faces":
            show({"id": store.label_face_cluster(args.cluster, args.name, _now(), models.embedder)})
        elif args.command == "resolve":
            for ids, accept in ((args.yes, True), (args.no, False)):
                for i in ids:
                    store.resolve_proposal(i, accept)
            show([r.asDict() for r in pending_proposals(store.read("merge_proposals"), store.read("entities")).limit(1000).collect()])
        elif args.command == "eval":
            data = evals.load_rows(args.file)
            show(evaluate_extraction(store, settings, models, data) if args.what == "extraction" else evaluate_answers(store, models, data))
        elif args.command == "profile":
            show({"saved": synthesize(store, models.renderer, _now())})
        elif args.command == "stats":
            s = stats(store, settings.runs, datetime.now())
            show(s) if args.json else print("\n".join(f"{k}: {v}" for k, v in s.items()))
        elif args.command == "ask":
            show(answer.answer_question(store, models, args.question))
        elif args.command == "serve":
            from quillon.serve import serve_tools

            serve_tools(store, models, sys.stdin, sys.stdout)
        else:
            from quillon.serve import serve_http

            serve_http(store, models, args.port)
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
