"""Readers and aggregates over facts, items, entities and history, as plain DataFrame functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import cited_ids, first_date
from quillon.operators.ordered import with_number
from quillon.operators.vector import search
from quillon.schemas import FACT_COLUMNS


def fact_columns(facts: DataFrame) -> DataFrame:
    return facts.select(*FACT_COLUMNS)


def of_kinds(facts: DataFrame, kinds: list[str] | None) -> DataFrame:
    """No kinds, or none given: no filter."""
    return facts.where(F.col("kind").isin(*kinds)) if kinds else facts


def as_of(facts: DataFrame, instant: datetime | Column | None) -> DataFrame:
    """Facts not yet expired at ``instant``: a fact with invalid_at equal to it is expired. valid_at and
    expired_at play no part. No instant: no filter."""
    if instant is None:
        return facts
    at = instant if isinstance(instant, Column) else F.lit(instant)
    return facts.where(F.col("invalid_at").isNull() | (F.col("invalid_at") > at))


def by_prefix(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.where(F.col("id").startswith(prefix)).orderBy("id").limit(1)


def for_entity(facts: DataFrame, entity_id: str, instant: datetime | Column | None = None) -> DataFrame:
    return as_of(facts, instant).where(F.array_contains("entity_ids", entity_id)).orderBy("created_at", "id")


def list_facts(facts: DataFrame, kinds: list[str] | None = None, limit: int = 1000, instant: datetime | Column | None = None) -> DataFrame:
    return as_of(of_kinds(facts, kinds), instant).orderBy("created_at", "id").limit(limit)


def search_facts(facts: DataFrame, query: list[float] | Column, limit: int = 20, kinds: list[str] | None = None, instant: datetime | Column | None = None, id_col: str = "id") -> DataFrame:
    return search(as_of(of_kinds(facts, kinds), instant), query, limit, id_col)


def within_dates(facts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Facts whose first date lies in the range, both ends included; facts without a date drop out."""
    day = first_date(F.col("happened_at"))
    kept = facts.where(day.isNotNull())
    if start is not None:
        kept = kept.where(day >= start)
    return kept if end is None else kept.where(day <= end)


def timeline(facts: DataFrame, start: str | None, end: str | None, instant: datetime | Column | None = None, most: int = 5000) -> DataFrame:
    """The first ``most`` facts by creation, then those in the range, by their first date."""
    some = list_facts(facts, None, most, instant)
    return within_dates(some, start, end).orderBy(first_date(F.col("happened_at")), "created_at", "id")


def search_memories(facts: DataFrame, query: list[float] | Column, entity_ids: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int = 10, instant: datetime | Column | None = None) -> DataFrame:
    """Nearest facts first, then the filters: fewer than ``limit`` rows may remain."""
    found = search_facts(facts, query, limit, None, instant)
    if entity_ids is not None:
        found = found.where(F.coalesce(F.arrays_overlap("entity_ids", F.array(*(F.lit(e) for e in entity_ids)).cast("array<string>")), F.lit(False)))
    if start is not None or end is not None:
        found = within_dates(found, start, end)
    return found


def cited(candidates: DataFrame, answer: str | Column) -> DataFrame:
    """Candidates whose whole id the answer cites; a shortened id matches nothing."""
    text = answer if isinstance(answer, Column) else F.lit(answer)
    return candidates.where(F.array_contains(cited_ids(text), F.col("id")))


def counts_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n"))


def fact_stats(facts: DataFrame) -> DataFrame:
    """(kind, total, mean_confidence): per kind and, with a null kind, for all; that row stands even for an empty
    table, with total 0 and no mean."""
    mean = F.avg(F.col("confidence").cast("double")).alias("mean_confidence")
    each = facts.groupBy("kind").agg(F.count("*").alias("total"), mean, F.lit(0).alias("is_total"))
    every = facts.agg(F.lit(None).cast("string").alias("kind"), F.count("*").alias("total"), mean, F.lit(1).alias("is_total"))
    return each.unionByName(every)


def entity_count(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("n"))


def confirm_queue(proposals: DataFrame) -> DataFrame:
    """(pending, oldest): 0 and null for an empty queue."""
    waiting = F.col("status") == "pending"
    return proposals.agg(F.count_if(waiting).alias("pending"), F.min(F.when(waiting, F.col("created_at"))).alias("oldest"))


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("event").agg(F.count("*").alias("n"))


def counts_by_entity(facts: DataFrame, entities: DataFrame | None = None, instant: datetime | Column | None = None) -> DataFrame:
    """(entity_id, n): a fact that names an entity twice counts twice; entities without facts are absent."""
    each = as_of(facts, instant).select(F.explode("entity_ids").alias("entity_id"))
    if entities is not None:
        each = each.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return each.groupBy("entity_id").agg(F.count("*").alias("n"))


def list_people(entities: DataFrame, facts: DataFrame, instant: datetime | Column | None = None) -> DataFrame:
    people = entities.where("kind = 'person'").select("id", "name")
    counts = counts_by_entity(facts, people, instant)
    return people.join(counts, people["id"] == counts["entity_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("fact_count"))


def pending_proposals(proposals: DataFrame, entities: DataFrame) -> DataFrame:
    waiting = proposals.where("status = 'pending'").select("id", "mention", "entity_id", "evidence", "score", "status", "created_at")
    names = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return waiting.join(names, "entity_id").orderBy("created_at", "id")


def with_provenance(facts: DataFrame, items: DataFrame) -> DataFrame:
    """(fact_id, item_id, source, sender, body): the items a fact cites and that exist."""
    cites = facts.select(F.col("id").alias("fact_id"), F.explode("provenance").alias("item_id")).distinct()
    return cites.join(items.select(F.col("id").alias("item_id"), "source", "sender", "body"), "item_id").select("fact_id", "item_id", "source", "sender", "body")


def link_subjects(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, entity_ids): facts with their subjects resolved through (mention, entity_id); unresolved subjects are
    dropped, facts without any resolved subject are left out."""
    each = facts.select("id", F.explode("subjects").alias("mention")).join(mentions.select("mention", "entity_id"), "mention")
    return each.groupBy("id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


# The sections of a profile in their order and the kinds that go into each.
SECTIONS = (("Identity", ("person", "place")), ("People", ("relationship",)), ("Timeline", ("event",)), ("Habits", ("habit",)), ("Preferences", ("preference",)))


def by_section(facts: DataFrame) -> DataFrame:
    """Facts with section, section_no and section_rank: kinds in the section's order, events by their time."""
    no, kind_no = F.lit(None).cast("int"), F.lit(0)
    name = F.lit(None).cast("string")
    for k, (title, kinds) in enumerate(SECTIONS):
        for j, kind in enumerate(kinds):
            no = F.when(F.col("kind") == kind, k + 1).otherwise(no)
            name = F.when(F.col("kind") == kind, title).otherwise(name)
            kind_no = F.when(F.col("kind") == kind, j).otherwise(kind_no)
    when = F.when(F.col("kind") == "event", F.coalesce("happened_at", F.lit(""))).otherwise(F.lit(""))
    placed = facts.withColumn("section_no", no).withColumn("section", name).where("section_no is not null").withColumn("__kind_no", kind_no).withColumn("__when", when)
    # There are only five sections, so ranks come from one numbering of all rows.
    numbered = with_number(placed, ["section_no", "__kind_no", "__when", "created_at", "id"], "__n")
    starts = F.broadcast(numbered.groupBy("section_no").agg(F.min("__n").alias("__start")))  # one row per section
    return numbered.join(starts, "section_no").withColumn("section_rank", F.col("__n") - F.col("__start") + 1).drop("__kind_no", "__when", "__n", "__start")
