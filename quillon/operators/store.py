"""The bi-temporal store: snapshot tables on Parquet with insert-or-ignore, change and audit operations.

Every table is a folder of numbered snapshots and a pointer to the current one. New rows are added as files of the
snapshot. A change writes the changed rows alone, as a numbered change set beside the snapshot; readers take the
latest row of a key, and so see whole writes. After ``MOST_CHANGES`` sets they are folded into a new snapshot, and
snapshots before the last one are deleted. A change set or snapshot that another writer has begun is an error, so two
writers do not overwrite each other. Audit rows are written before what they tell of, and once, so that a write that
was cut off can be repeated.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon import schemas
from quillon.identity import entity_id, statement_hash, uuid_of
from quillon.models.offline import BagEmbedder
from quillon.operators.windows import first_by_min
from quillon.session import release, settle_table

#: Change sets of a table that readers merge.
MOST_CHANGES = 16
# What may change in a stored fact.
CHANGEABLE = ("kind", "confidence", "entity_ids", "happened_at", "invalid_at")


class SnapshotTable:
    """One table of the store."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, key: str = "id") -> None:
        self.key = key
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{name}", schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> int:
        at = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(at):
            return 0
        stream = self._fs.open(at)
        try:
            return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _changes(self, version: int) -> list[str]:
        """The folders of the complete change sets of a snapshot, in their order."""
        found = self._fs.globStatus(self._path(f"{self.path}/v{version}-change-*/_SUCCESS"))
        return sorted(str(f.getPath().getParent().toString()) for f in found or [])

    def read(self) -> DataFrame:
        version = self._pointer()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")
        sets = self._changes(version)
        if not sets:
            return base
        columns = [f.name for f in self.schema]
        numbered = [self.spark.read.schema(self.schema).parquet(s).withColumn("__no", F.lit(k)) for k, s in enumerate(sets)]
        changed = functools.reduce(DataFrame.unionByName, numbered)
        if len(sets) > 1:
            last = changed.groupBy(self.key).agg(F.max("__no").alias("__no"))
            changed = changed.join(last, [self.key, "__no"])
        changed = changed.select(*columns)
        return base.join(changed.select(self.key), self.key, "left_anti").select(*columns).unionByName(changed)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the next snapshot."""
        version = self._pointer()
        self._fit(rows).write.mode("errorifexists").parquet(f"{self.path}/v{version + 1}")
        self._move(version + 1)
        for old in self._fs.globStatus(self._path(f"{self.path}/v{version - 1}*")) or []:
            if old.getPath().getName().split("-")[0] == f"v{version - 1}":
                self._fs.delete(old.getPath(), True)

    def change(self, rows: DataFrame) -> None:
        """Put ``rows``, whole and one for each key that exists, in place of the stored ones."""
        version = self._pointer()
        done = self._changes(version)
        self._fit(rows).write.mode("errorifexists").parquet(f"{self.path}/v{version}-change-{len(done):06d}")
        if len(done) + 1 >= MOST_CHANGES:
            self.replace(self.read())

    def append(self, rows: DataFrame) -> None:
        version = self._pointer()
        self._fit(rows).write.mode("append").parquet(f"{self.path}/v{max(version, 1)}")
        if not version:
            self._move(1)

    def _fit(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))

    def _move(self, version: int) -> None:
        stream = self._fs.create(self._path(f"{self.path}/CURRENT"), True)
        stream.write(bytearray(str(version).encode()))
        stream.close()


def new_rows(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows that insert-or-ignore adds: first of each key by ``order``, keys not there yet. Rows with a null
    key are ignored."""
    batch = first_by_min(incoming.where(F.col(key).isNotNull()), [key], order)
    return batch.join(existing.select(key), key, "left_anti").select(*incoming.columns)


class Store:
    """All tables under one folder."""

    TABLES = {
        "raw_items": schemas.RAW_ITEM, "facts": schemas.FACT, "fact_history": schemas.FACT_HISTORY, "entities": schemas.ENTITY,
        "merge_proposals": schemas.MERGE_PROPOSAL, "profiles": schemas.PROFILE, "extracted_windows": schemas.EXTRACTED_WINDOW,
    }

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.tables = {name: SnapshotTable(spark, root, name, schema, schema.fields[0].name) for name, schema in self.TABLES.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _insert(self, name: str, incoming: DataFrame, key: str, order: list[str]) -> int:
        added = new_rows(self.read(name), incoming, key, order).persist()
        try:
            n = added.count()
            if n:
                self.tables[name].append(added)
            return n
        finally:
            added.unpersist()

    def add_raw_items(self, items: DataFrame) -> int:
        """Insert-or-ignore on the id; the number of rows that were new."""
        return self._insert("raw_items", items, "id", ["seq"])

    def add_facts(self, facts: DataFrame, now: datetime) -> DataFrame:
        """Insert-or-ignore on the statement's hash, with a history row for each new fact. ``facts`` needs seq, kind
        and statement. Returns (seq, id): every input row with the id of the stored fact."""
        at = F.lit(now).cast("timestamp")
        keyed = facts.withColumn("hash", statement_hash(F.col("statement"))).withColumn("id", uuid_of(F.col("hash")))
        for c in ("valid_at", "created_at", "updated_at"):
            keyed = keyed.withColumn(c, at)
        if "entity_ids" in keyed.columns:
            keyed = keyed.withColumn("entity_ids", F.when(F.size("entity_ids") > 0, F.col("entity_ids")))
        added = new_rows(self.read("facts"), keyed, "hash", ["seq"]).persist()
        try:
            if added.limit(1).count():
                body = F.to_json(F.struct(*(F.col(c) for c in added.columns if c not in ("embedding", "seq", "valid_at", "created_at", "updated_at"))))
                self._log(added.select(F.col("id").alias("fact_id"), F.lit("ADD").alias("event"), F.lit(None).cast("string").alias("prev"), body.alias("next"), at.alias("at")))
                self.tables["facts"].append(added)
        finally:
            added.unpersist()
        return keyed.select("seq", "id")

    def _log(self, rows: DataFrame) -> None:
        told = self.read("fact_history")
        start = told.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = rows.join(told.select("fact_id", "event", "at"), ["fact_id", "event", "at"], "left_anti")
        self.tables["fact_history"].append(rows.withColumn("id", F.monotonically_increasing_id() + F.lit(start + 1)))

    def update_facts(self, changes: DataFrame, now: datetime) -> None:
        """Change stored facts: ``changes`` has id and some of the changeable columns; null means unchanged, so an
        expired fact stays expired. Unknown columns are a ValueError, unknown ids a KeyError. A change that sets
        invalid_at is logged as EXPIRE, any other as UPDATE, one without a value not at all."""
        names = [c for c in changes.columns if c != "id"]
        if bad := sorted(set(names) - set(CHANGEABLE)):
            raise ValueError(f"not changeable: {', '.join(bad)}")
        if not names:
            return
        facts = self.read("facts")
        unknown = changes.join(facts.select("id"), "id", "left_anti").select("id").head(1)
        if unknown:
            raise KeyError(unknown[0][0])
        given = F.struct(*(F.col(c).alias(c) for c in names))
        any_given = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(True)) for c in names), F.lit(False))
        real = changes.where(any_given).select("id", given.alias("__new"))
        hit = facts.join(real, "id").persist()
        try:
            event = F.when(F.col("__new.invalid_at").isNotNull(), "EXPIRE").otherwise("UPDATE") if "invalid_at" in names else F.lit("UPDATE")
            before = F.to_json(F.struct(*(F.col(c) for c in facts.columns if c != "embedding")))
            at = F.lit(now).cast("timestamp")
            self._log(hit.select(F.col("id").alias("fact_id"), event.alias("event"), before.alias("prev"), F.to_json("__new").alias("next"), at.alias("at")))
            columns = [F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in names else at.alias(c) if c == "updated_at" else F.col(c) for c in facts.columns]
            if hit.limit(1).count():
                self.tables["facts"].change(hit.select(*columns))
        finally:
            hit.unpersist()

    def upsert_entities(self, entities: DataFrame, now: datetime) -> DataFrame:
        """Insert-or-ignore on (name, kind), exact case; the first embedding stays. ``entities`` needs seq, name and
        kind. Returns (name, kind, id)."""
        keyed = entities.withColumn("id", entity_id(F.col("name"), F.col("kind"))).withColumn("created_at", F.lit(now).cast("timestamp"))
        if "aliases" not in keyed.columns:
            keyed = keyed.withColumn("aliases", F.array().cast("array<string>"))
        self._insert("entities", keyed, "id", ["seq"])
        return keyed.select("name", "kind", "id").distinct()

    def add_aliases(self, aliases: DataFrame) -> None:
        """Add (entity_id, alias) pairs; an alias an entity already has changes nothing."""
        more = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_set("alias")).alias("__more"))
        old = self.read("entities")
        both = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("__more", F.array().cast("array<string>"))))
        changed = settle_table(old.join(more, "id").withColumn("aliases", both).select(*old.columns), "aliases")
        if changed.head(1):
            self.tables["entities"].change(changed)
        release(changed)

    def label_face_cluster(self, cluster: int, name: str, now: datetime, embedder: BagEmbedder | None = None) -> str:
        """A person of this name with the cluster as an alias; returns the id. The name gets a vector, without which
        no mention would find it."""
        vector = (embedder or BagEmbedder()).embed_docs([name])[0]
        row = self.spark.createDataFrame([(0, name, "person", vector)], "seq long, name string, kind string, embedding array<float>")
        made = self.upsert_entities(row, now).first()["id"]
        self.add_aliases(self.spark.createDataFrame([(made, f"face:{cluster}")], "entity_id string, alias string"))
        return made

    def find_by_alias(self, alias: str) -> DataFrame:
        return self.read("entities").where(F.array_contains("aliases", alias)).orderBy("id").limit(1)

    def get_entity(self, id_: str) -> DataFrame:
        return self.read("entities").where(F.col("id") == id_)

    def list_entities(self, kind: str | None = None) -> DataFrame:
        rows = self.read("entities")
        return (rows.where(F.col("kind") == kind) if kind else rows).orderBy("name")

    def add_proposals(self, proposals: DataFrame, now: datetime) -> None:
        """Queue (mention, entity_id, score and, where there is any, evidence) for a person to decide."""
        at = F.lit(now).cast("timestamp")
        key = uuid_of(F.concat_ws("|", "mention", "entity_id", F.lit(now.isoformat())))
        evidence = F.col("evidence") if "evidence" in proposals.columns else F.lit(None).cast("string")
        self.tables["merge_proposals"].append(proposals.select(key.alias("id"), "mention", "entity_id", evidence.alias("evidence"), F.col("score").cast("float").alias("score"), F.lit("pending").alias("status"), at.alias("created_at")))

    def resolve_proposal(self, id_: str, accept: bool) -> None:
        """Set the state; entities and aliases stay as they are."""
        row = self.read("merge_proposals").where(F.col("id") == id_).limit(1).collect()  # one row
        if row:
            decided = self.spark.createDataFrame(row, self.TABLES["merge_proposals"])
            self.tables["merge_proposals"].change(decided.withColumn("status", F.lit("confirmed" if accept else "rejected")))

    def save_profile(self, body: str, fact_count: int, now: datetime) -> None:
        row = self.spark.createDataFrame([(f"{now.isoformat()}", body, fact_count, now)], self.TABLES["profiles"])
        self.tables["profiles"].append(row)

    def latest_profile(self) -> DataFrame:
        return self.read("profiles").orderBy(F.desc("created_at"), F.desc("id")).limit(1)

    def mark_windows(self, hashes: DataFrame, outcome: str | Column, now: datetime) -> int:
        """Record outcomes; the first one of a window stays."""
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        rows = hashes.select("window_hash", value.alias("outcome"), F.lit(now).cast("timestamp").alias("created_at"))
        return self._insert("extracted_windows", rows, "window_hash", ["outcome"])

    def pending_windows(self, windows: DataFrame) -> DataFrame:
        return windows.join(self.read("extracted_windows").select("window_hash"), "window_hash", "left_anti")

    def skipped_windows(self, windows: DataFrame) -> DataFrame:
        """(outcome, n): distinct hashes that are skipped, by their outcome."""
        seen = self.read("extracted_windows").join(windows.select("window_hash").distinct(), "window_hash", "left_semi")
        return seen.groupBy("outcome").agg(F.count("*").alias("n"))

    def clear_given_up(self) -> int:
        rows = self.read("extracted_windows")
        n = rows.where("outcome = 'gave_up'").count()
        if n:
            self.tables["extracted_windows"].replace(rows.where("outcome <> 'gave_up'"))
        return n
