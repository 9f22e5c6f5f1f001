"""The six tools over a store, as plain functions that return rows or JSON-ready values."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.models.offline import Models
from quillon.operators import facts as fx
from quillon.operators.profile import section
from quillon.operators.resolve import lookup
from quillon.operators.store import Store

# How many facts each sub-question fetches, how many sub-questions there may be.
PER_QUERY, MOST_QUERIES = 5, 3
_TOOL = ("kind", "statement", "confidence", "happened_at", "provenance")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def tool_rows(rows: DataFrame) -> list[dict]:
    """Rows as tools show them: without ids and times, provenance as sources."""
    shown = [c for c in _TOOL if c in rows.columns]
    return [{("sources" if k == "provenance" else k): v for k, v in r.asDict(True).items()} for r in rows.select(*shown).collect()]


def retrieve(store: Store, queries: list[str], models: Models, limit: int = PER_QUERY, instant: datetime | None = None) -> DataFrame:
    """The nearest facts of each query, each fact once, in the order of first sight. Without an instant expired
    facts count too."""
    out = None
    for k, q in enumerate(queries[:MOST_QUERIES]):
        got = fx.search_facts(store.read("facts"), models.embedder.embed_query(q), limit, None, instant).select(*fx.FACT_COLUMNS, "similarity").withColumn("query_no", F.lit(k))
        out = got if out is None else out.unionByName(got)
    first = out.groupBy("id").agg(F.min(F.struct("query_no", (-F.col("similarity")).alias("far"), "id")).alias("at"))
    return out.join(first.select(F.col("at.query_no").alias("query_no"), "id", F.col("at.far").alias("far")), ["id", "query_no"]).orderBy("query_no", "far", "id").drop("query_no", "far")


def search_memories(store: Store, models: Models, query: str, people: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int = 10, include_expired: bool = False) -> list[dict]:
    ids = lookup(store, people, models.embedder, models.judge, _now()) if people else None
    rows = fx.search_memories(store.read("facts"), models.embedder.embed_query(query), ids, start, end, limit, None if include_expired else _now())
    return tool_rows(rows)


def answer_question(store: Store, models: Models, question: str) -> dict:
    """An answer with the facts that it cites by their whole id."""
    now = _now()
    queries = (models.planner(question) or [question])[:MOST_QUERIES]
    found = retrieve(store, queries, models, PER_QUERY, now).collect()  # at most PER_QUERY * MOST_QUERIES rows
    lines = [f"[fact:{r['id']}] {r['statement']}" for r in found]
    answer = models.answerer(question, "\n".join(lines) or "(no facts retrieved)")
    kept = store.spark.createDataFrame([r.asDict() for r in found], schema=store.read("facts").select(*fx.FACT_COLUMNS).schema) if found else None
    cited = [] if kept is None else [r.asDict(True) for r in fx.cited(kept, answer).collect()]
    return {"answer": answer, "facts": cited}


def get_profile(store: Store, name: str | None = None) -> str:
    return section(store, name)


def query_timeline(store: Store, start: str | None = None, end: str | None = None, include_expired: bool = False) -> list[dict]:
    return tool_rows(fx.timeline(store.read("facts"), start, end, None if include_expired else _now()))


def get_person(store: Store, models: Models, name: str) -> dict:
    ids = lookup(store, [name], models.embedder, models.judge, _now())
    if not ids:
        return {"found": False}
    card = store.get_entity(ids[0]).select("id", "name", "kind", "aliases").first()
    return {"found": True, **card.asDict(True), "facts": tool_rows(fx.for_entity(store.read("facts"), ids[0], _now()))}


def list_people(store: Store) -> list[dict]:
    return [r.asDict() for r in fx.list_people(store.read("entities"), store.read("facts"), _now()).orderBy("name").collect()]


def fact_by_prefix(store: Store, prefix: str) -> dict | None:
    row = fx.by_prefix(fx.fact_columns(store.read("facts")), prefix).head(1)
    return row[0].asDict(True) if row else None
