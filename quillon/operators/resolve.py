"""Resolution of mentions to entities through tiers, with a queue of matches for a person to confirm.

Similarities are computed for all mentions at once. The tiers are replayed in the mentions' sorted order, since each
mention may create an entity that later ones match; only similar mentions can meet so, hence each connected component
of the graph of similar mentions is replayed by itself, in a task. Nothing but the outcome leaves the executors.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import _EMOJI
from quillon.identity import entity_id
from quillon.models.offline import BagEmbedder
from quillon.operators.extract import embed
from quillon.operators.graph import components
from quillon.operators.store import Store
from quillon.operators.vector import nearest_batch, similar
from quillon.session import settle_table

# Candidates per mention, the least similarity of one, the confidence that merges without asking.
CANDIDATES, FLOOR, MERGES_FROM = 15, 0.6, 0.85


def normal(name: str) -> str:
    text = _EMOJI.sub("", name or "").replace(".", " ").replace("_", " ").replace("-", " ")
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _first(name: str) -> str:
    return (normal(name).split() or [""])[0]


@dataclass
class Replay:
    """What the tiers decided."""

    resolved: dict[str, str] = field(default_factory=dict)
    created: list[str] = field(default_factory=list)
    proposals: list[tuple[str, str, float]] = field(default_factory=list)


def replay(
    mentions: list[str],
    candidates: dict[str, list[tuple[str, str, tuple[str, ...], float]]],
    between: dict[tuple[str, str], float],
    faces: dict[str, str],
    judge: Callable[[str, str], dict],
    existing_people: dict[str, str] | None = None,
    create: bool = True,
) -> Replay:
    """The tiers over sorted mentions. ``candidates``: (id, name, aliases, similarity) per mention, any number;
    ``between``: similarity of a mention to an earlier one that may have been created; ``faces``: ids by label."""
    out, made = Replay(), {}
    for m in sorted(set(mentions)):
        if m.startswith("face:"):
            if m in faces:
                out.resolved[m] = faces[m]
            continue
        near = [*candidates.get(m, []), *((made[c], c, (), between.get((m, c), -1.0)) for c in made)]
        near = [c for c in sorted(near, key=lambda c: (-c[3], c[0]))[:CANDIDATES] if c[3] >= FLOOR]
        if not near:
            if create:
                known = (existing_people or {}).get(m)
                made[m] = out.resolved[m] = known or f"new:{m}"
                if known is None:
                    out.created.append(m)
            continue
        n = normal(m)
        exact = [c for c in near if n and (n == normal(c[1]) or n in map(normal, c[2]))]
        if len(exact) == 1:
            out.resolved[m] = exact[0][0]
            continue
        a = _first(m)
        prefix = [c for c in near if a and _first(c[1]) and (a.startswith(_first(c[1])) or _first(c[1]).startswith(a))]
        if len(prefix) == 1:
            out.resolved[m] = prefix[0][0]
            continue
        verdicts = [(c, judge(m, c[1])) for c in near]
        same = [(c, v) for c, v in verdicts if v["same"]]
        best = max(same, key=lambda x: x[1]["confidence"], default=None)
        if best and best[1]["confidence"] >= MERGES_FROM:
            out.resolved[m] = best[0][0]
        else:
            out.proposals += [(m, c[0], float(v["confidence"])) for c, v in same]
    return out


def _candidates(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, candidates): the nearest entities of each mention, any kind, at most ``CANDIDATES``."""
    near = nearest_batch(queries, entities.where("embedding is not null"), CANDIDATES, "mention", "id")
    joined = near.join(entities.select("id", "name", "aliases"), "id")
    return joined.groupBy("mention").agg(F.collect_list(F.struct("id", "name", "aliases", "similarity")).alias("candidates"))


def resolve(store: Store, mentions: DataFrame, embedder: BagEmbedder, judge: Callable[[str, str], dict], now: datetime, create: bool = True) -> DataFrame:
    """(mention, entity_id) of the resolved mentions; creations and proposals are written in one batch each."""
    names = settle_table(mentions.select("mention").where("mention is not null").distinct(), "mentions")
    entities = store.read("entities")
    labelled = F.col("mention").startswith("face:")
    by_label = entities.select("id", F.explode("aliases").alias("mention")).groupBy("mention").agg(F.min("id").alias("entity_id"))
    faces = names.where(labelled).join(by_label, "mention")
    plain = names.where(~labelled)

    @F.arrow_udf("array<float>")
    def as_query(t: pa.Array) -> pa.Array:
        return pa.array([embedder.embed_query(x) for x in t.to_pylist()], pa.list_(pa.float32()))

    queries = settle_table(plain.withColumn("embedding", as_query("mention")), "queries")
    docs = embed(plain.withColumnRenamed("mention", "id"), "id", embedder)
    earlier = settle_table(similar(queries, docs, FLOOR, "mention", "id").where("id < mention"), "earlier")
    between = earlier.groupBy("mention").agg(F.collect_list(F.struct("id", "similarity")).alias("earlier"))
    parts = components(earlier, "mention", "id").withColumnRenamed("vertex", "mention")
    people = entities.where("kind = 'person'").groupBy(F.col("name").alias("mention")).agg(F.min("id").alias("person"))
    rows = plain.join(_candidates(queries, entities), "mention", "left").join(between, "mention", "left").join(parts, "mention", "left").join(people, "mention", "left")
    rows = rows.withColumn("component", F.coalesce("component", "mention"))

    def play(part: pa.Table) -> pa.Table:
        found, near, known, own = {}, {}, {}, []
        for r in part.to_pylist():
            own.append(r["mention"])
            found[r["mention"]] = [(c["id"], c["name"], tuple(c["aliases"] or ()), c["similarity"]) for c in r["candidates"] or ()]
            near.update({(r["mention"], e["id"]): e["similarity"] for e in r["earlier"] or ()})
            if r["person"] is not None:
                known[r["mention"]] = r["person"]
        done = replay(own, found, near, {}, judge, known, create)
        out = [(m, e, "resolved", None) for m, e in done.resolved.items()] + [(m, None, "created", None) for m in done.created] + [(m, e, "proposed", s) for m, e, s in done.proposals]
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["mention", "entity_id", "state", "score"])

    outcome = rows.groupBy("component").applyInArrow(play, "mention string, entity_id string, state string, score double")
    # An entity made in this run has the id that its name and kind give.
    fresh = F.when(F.col("entity_id").startswith("new:"), entity_id(F.substr("entity_id", F.lit(5)), F.lit("person"))).otherwise(F.col("entity_id"))
    outcome = settle_table(outcome.withColumn("entity_id", fresh), "outcome")  # a judge is asked once
    made = outcome.where("state = 'created'")
    if made.head(1):
        store.upsert_entities(embed(made.select(F.col("mention").alias("seq"), F.col("mention").alias("name"), F.lit("person").alias("kind")), "name", embedder), now)
    queued = outcome.where("state = 'proposed'")
    if queued.head(1):
        # Only candidates that the judge takes for the same are queued.
        store.add_proposals(queued.select("mention", "entity_id", F.format_string("verdict: same=True confidence=%.2f", "score").alias("evidence"), "score"), now)
    return outcome.where("state = 'resolved'").select("mention", "entity_id").unionByName(faces.select("mention", "entity_id"))


def lookup(store: Store, names: list[str], embedder: BagEmbedder, judge: Callable[[str, str], dict], now: datetime) -> list[str]:
    """Entity ids of names, without creating any; proposals may still be queued."""
    if not names:
        return []
    rows = store.spark.createDataFrame([(n,) for n in names], "mention string")
    return sorted({r["entity_id"] for r in resolve(store, rows, embedder, judge, now, create=False).collect()})
