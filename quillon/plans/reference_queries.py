"""Queries of the operators over the test tables, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import identity
from quillon.functions import scalars
from quillon.operators import facts as fx
from quillon.operators import vector, windows
from quillon.operators.store import new_rows
from quillon.session import table

QUERIES = {}
SQL: dict[str, str] = {}
AS_OF = datetime(2024, 1, 1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
SELECT DISTINCT id, substr(sha256(concat(coalesce(source,''),'|',coalesce(export_id,''),'|',strftime(ingested_at,'%Y-%m-%dT%H:%M:%S'),
  CASE WHEN microsecond(ingested_at) % 1000000 = 0 THEN '' ELSE strftime(ingested_at,'.%f') END,'+00:00','|',coalesce(sender,''),'|',
  coalesce(nullif(body,''),media_path,''))),1,16) AS derived_id FROM raw_items""")
def raw_item_identity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_items")
    c = F.col
    return r.select("id", identity.item_id(c("source"), c("export_id"), c("ingested_at"), c("sender"), c("body"), c("media_path")).alias("derived_id")).distinct()


@query("SELECT source, count(*) AS n FROM raw_items GROUP BY source")
def raw_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return fx.counts_by_source(table(spark, d, "raw_items"))


@query("""
WITH batch AS (SELECT * FROM (SELECT id, sender, body, ingested_at, row_number() OVER (PARTITION BY id ORDER BY ingested_at, sender, body) AS n FROM raw_items WHERE ingested_at >= TIMESTAMP '2024-01-01') WHERE n = 1)
SELECT id, ingested_at FROM batch b WHERE NOT EXISTS (SELECT 1 FROM raw_items r WHERE r.ingested_at < TIMESTAMP '2024-01-01' AND r.id = b.id)""")
def ingest_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_items").select("id", "sender", "body", "ingested_at")
    cut = F.lit(AS_OF).cast("timestamp_ntz")
    return new_rows(r.where(F.col("ingested_at") < cut), r.where(F.col("ingested_at") >= cut), "id", ["ingested_at", "sender", "body"]).select("id", "ingested_at")


_WINDOWS = """
WITH s AS (SELECT *, row_number() OVER w AS rn, lag(ts) OVER w AS pts, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN coalesce(ts - pts > INTERVAL {gap} MINUTE, false) OR event_type = 'signup' OR coalesce(pt = 'signup', false) THEN 1 ELSE 0 END AS brk FROM s),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY rn) AS island FROM b),
c AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id, island ORDER BY rn) - 1) / {most}) AS INTEGER) AS chunk FROM i),
g AS (SELECT user_id, island, chunk, count(*) AS n_items, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY rn) AS ids FROM c GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY island, chunk) AS window_no, n_items, sha256(ids) AS window_hash FROM g"""


def _event_windows(spark: SparkSession, d: str, most: int, gap: int) -> DataFrame:
    return windows.conversation_windows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id", "ts", most, gap, F.col("event_type") == "signup").drop("ids")


@query(_WINDOWS.format(gap=180, most=40))
def conversation_windows(spark: SparkSession, d: str) -> DataFrame:
    return _event_windows(spark, d, 40, 180)


@query(_WINDOWS.format(gap=1440, most=5))
def conversation_windows_capped(spark: SparkSession, d: str) -> DataFrame:
    return _event_windows(spark, d, 5, 1440)


@query(f"""
WITH w AS ({_WINDOWS.format(gap=180, most=40)}), seen AS (SELECT window_hash, CASE WHEN user_id % 3 = 0 THEN 'gave_up' ELSE 'extracted' END AS outcome FROM w WHERE user_id % 2 = 0)
SELECT outcome, count(*) AS n FROM seen GROUP BY outcome UNION ALL SELECT 'pending', count(*) FROM w WHERE window_hash NOT IN (SELECT window_hash FROM seen)""")
def window_counters(spark: SparkSession, d: str) -> DataFrame:
    w = _event_windows(spark, d, 40, 180)
    seen = w.where("user_id % 2 = 0").select("window_hash", F.when(F.col("user_id") % 3 == 0, "gave_up").otherwise("extracted").alias("outcome"))
    pending = w.join(seen.select("window_hash"), "window_hash", "left_anti").agg(F.lit("pending").alias("outcome"), F.count("*").alias("n"))
    return seen.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(pending)


@query("""
WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 180 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM b)
SELECT user_id, island + 1 AS session_no, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM i GROUP BY user_id, island""")
def session_gap_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.session_gaps(table(spark, d, "events"), "user_id", "ts", 180)


@query("""
SELECT h AS hash, id FROM (SELECT md5(statement) AS h, id, row_number() OVER (PARTITION BY md5(statement) ORDER BY created_at, id) AS n FROM facts WHERE statement IS NOT NULL) WHERE n = 1""")
def fact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").select(identity.statement_hash(F.col("statement")).alias("hash"), "id", "created_at").where("hash is not null")
    return windows.first_by_min(f, ["hash"], ["created_at", "id"]).select("hash", "id")


@query("""
WITH f AS (SELECT id, min(created_at) AS c, min(invalid_at) AS i, min(updated_at) AS u, max(updated_at) AS u2 FROM facts GROUP BY id)
SELECT event, count(*) AS n FROM (SELECT 'ADD' AS event FROM f UNION ALL SELECT 'EXPIRE' FROM f WHERE i IS NOT NULL UNION ALL SELECT 'UPDATE' FROM f WHERE u2 > c) GROUP BY event""")
def fact_history_events(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").groupBy("id").agg(F.min("created_at").alias("c"), F.min("invalid_at").alias("i"), F.max("updated_at").alias("u"))
    events = F.filter(F.array(F.lit("ADD"), F.when(F.col("i").isNotNull(), "EXPIRE"), F.when(F.col("u") > F.col("c"), "UPDATE")), lambda x: x.isNotNull())
    return fx.history_counts(f.select(F.explode(events).alias("event")))


_STATS = "SELECT kind, count(*) AS total, round(avg(CAST(confidence AS DOUBLE)), 9) AS mean_confidence, 0 AS is_total FROM {t} GROUP BY kind UNION ALL SELECT NULL, count(*), round(avg(CAST(confidence AS DOUBLE)), 9), 1 FROM {t}"


@query(_STATS.format(t="facts"))
def fact_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    return fx.fact_stats(table(spark, d, "facts")).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(_STATS.format(t="(SELECT * FROM facts WHERE false)"))
def fact_stats_empty(spark: SparkSession, d: str) -> DataFrame:
    return fx.fact_stats(table(spark, d, "facts").where("false")).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("SELECT id, kind, invalid_at FROM facts WHERE invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-01'")
def as_of_facts(spark: SparkSession, d: str) -> DataFrame:
    return fx.as_of(table(spark, d, "facts"), F.lit(AS_OF).cast("timestamp_ntz")).select("id", "kind", "invalid_at")


@query("SELECT id, kind, created_at FROM facts WHERE kind IN ('event', 'habit') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-01') ORDER BY created_at, id LIMIT 1000")
def list_facts(spark: SparkSession, d: str) -> DataFrame:
    return fx.list_facts(table(spark, d, "facts"), ["event", "habit"], 1000, F.lit(AS_OF).cast("timestamp_ntz")).select("id", "kind", "created_at")


@query("SELECT id, statement FROM facts WHERE starts_with(id, 'a') ORDER BY id, updated_at LIMIT 1")
def fact_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fx.by_prefix(table(spark, d, "facts"), "a").select("id", "statement")


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings")
    return e.withColumnsRenamed({"vec_id": "id"}), e.where("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY similarity DESC NULLS LAST, id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    return vector.search(rows, q, 20).select("id", "label", "similarity")


@query(f"SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS similarity FROM embeddings WHERE label IN (1, 2) ORDER BY similarity DESC NULLS LAST, id LIMIT 20")
def vector_topk_kind(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    return vector.search(rows.where(F.col("label").isin(1, 2)), q, 20).select("id", "label", "similarity")


@query("""
SELECT q_id, row_id, similarity, rank FROM (
  SELECT a.vec_id AS q_id, b.vec_id AS row_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0) WHERE rank <= 15 AND similarity >= 0.35""")
def nearest_entities_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.nearest_batch(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), e.withColumnRenamed("vec_id", "row_id"), 15, "q_id", "row_id", floor=0.35)


@query("""
WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) <= 0.58),
r(v, m) AS (SELECT a, a FROM p UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.v WHERE r.m < p.b),
l AS (SELECT v, min(m) AS c FROM r GROUP BY v), k AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM l))
SELECT e.vec_id, CAST(coalesce(k.label, -1) AS INTEGER) AS label FROM embeddings e LEFT JOIN l ON l.v = e.vec_id LEFT JOIN k ON k.c = l.c""")
def face_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vector.face_clusters(table(spark, d, "embeddings").drop("label"), 0.58, "vec_id")


@query("""
SELECT o_orderkey, month, round FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS round
  FROM orders WHERE o_orderpriority <> '5-LOW') WHERE round <= 50 ORDER BY round, month LIMIT 50""")
def vision_round_robin(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return windows.round_robin(o, "month", "o_totalprice", "o_orderkey", 50).select("o_orderkey", "month", "round")


@query("""
SELECT e AS entity_id, count(*) AS n FROM (SELECT unnest(entity_ids) AS e FROM facts WHERE invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-01') WHERE e IN (SELECT id FROM entities) GROUP BY e""")
def entity_fact_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.counts_by_entity(table(spark, d, "facts"), table(spark, d, "entities"), F.lit(AS_OF).cast("timestamp_ntz"))


@query("""
WITH c AS (SELECT e, count(*) AS n FROM (SELECT unnest(entity_ids) AS e FROM facts) GROUP BY e)
SELECT p.id, p.name, coalesce(c.n, 0) AS fact_count FROM entities p LEFT JOIN c ON c.e = p.id WHERE p.kind = 'person'""")
def list_people(spark: SparkSession, d: str) -> DataFrame:
    return fx.list_people(table(spark, d, "entities"), table(spark, d, "facts"))


@query("SELECT id, statement FROM facts WHERE list_contains(entity_ids, (SELECT min(id) FROM entities))")
def facts_for_entity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").agg(F.min("id")).first()[0]
    return fx.for_entity(table(spark, d, "facts"), e).select("id", "statement")


@query("""
SELECT DISTINCT f.fact_id, r.id AS item_id, r.source, r.sender FROM (SELECT id AS fact_id, unnest(provenance) AS item FROM facts) f JOIN raw_items r ON r.id = f.item""")
def provenance_join(spark: SparkSession, d: str) -> DataFrame:
    return fx.with_provenance(table(spark, d, "facts"), table(spark, d, "raw_items")).select("fact_id", "item_id", "source", "sender").distinct()


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    state = F.element_at(F.array(F.lit("pending"), F.lit("confirmed"), F.lit("rejected")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("mention"), F.col("p_size").cast("long").alias("entity_id"), F.col("p_type").alias("evidence"), F.col("p_retailprice").alias("score"), state.alias("status"), F.col("p_partkey").alias("created_at"))


@query("""
SELECT p_partkey AS id, p_name AS mention, n_name AS entity_name, p_type AS evidence, p_retailprice AS score FROM part JOIN nation ON n_nationkey = p_size WHERE p_partkey % 3 = 0""")
def pending_proposals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return fx.pending_proposals(_proposals(spark, d), n).select("id", "mention", "entity_name", "evidence", "score")


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS pending, min(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) AS oldest FROM part")
def confirm_queue(spark: SparkSession, d: str) -> DataFrame:
    return fx.confirm_queue(_proposals(spark, d))


@query("SELECT count(*) AS n FROM entities")
def entity_count(spark: SparkSession, d: str) -> DataFrame:
    return fx.entity_count(table(spark, d, "entities"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(upper(p_name) || '.' || p_brand || '__' || p_type, '[._-]+', ' ', 'g')), '\\s+', ' ', 'g')) AS normalized FROM part""")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.upper("p_name"), F.lit("."), "p_brand", F.lit("__"), "p_type")
    return table(spark, d, "part").select("p_partkey", scalars.normalize_name(name).alias("normalized"))


@query("""
SELECT p_partkey FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, 2) ELSE split_part(p_type, ' ', 1) END AS b FROM part)
WHERE starts_with(lower(a), lower(b)) OR starts_with(lower(b), lower(a))""")
def prefix_tier(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 2 == 0, F.substr("p_name", F.lit(1), F.lit(2))).otherwise(F.col("p_type"))
    return table(spark, d, "part").where(scalars.prefix_related(scalars.normalize_ascii_name(F.col("p_name")), scalars.normalize_ascii_name(other))).select("p_partkey")


@query("SELECT doc_id, md5(text) AS repaired_md5 FROM documents WHERE text IS NOT NULL")
def mojibake_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.select("doc_id", F.md5(scalars.utf8_read_as_latin1(damaged)).alias("repaired_md5"))


_EMOJI_SQL = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}]"


@query(f"""
SELECT DISTINCT name, trim(regexp_replace(lower(nfc_normalize(regexp_replace(regexp_replace(name, '{_EMOJI_SQL}', '', 'g'), '[._-]+', ' ', 'g'))), '[\\s\\xA0]+', ' ', 'g')) AS normalized
FROM (SELECT name FROM entities UNION ALL SELECT unnest(aliases) FROM entities) WHERE name IS NOT NULL""")
def name_normalize_unicode(spark: SparkSession, d: str) -> DataFrame:
    """Names with emoji, marks and separators, as people typed them."""
    e = table(spark, d, "entities")
    names = e.select("name").unionByName(e.select(F.explode("aliases").alias("name"))).where("name is not null").distinct()
    return names.select("name", scalars.normalize_name(F.col("name")).alias("normalized"))


@query("""
WITH a AS (SELECT id, 'As noted [fact:' || id || '] and [fact:' || substr(id, 1, 8) || '].' AS answer FROM facts)
SELECT DISTINCT id, regexp_extract_all(answer, '\\[fact:([0-9a-fA-F-]+)\\]', 1)[1] AS first_cited, len(regexp_extract_all(answer, '\\[fact:([0-9a-fA-F-]+)\\]', 1)) AS n_cited FROM a""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").select("id", F.concat(F.lit("As noted [fact:"), "id", F.lit("] and "), identity.citation(F.col("id")), F.lit(".")).alias("answer"))
    return fx.cited(f, F.col("answer")).select("id", F.element_at(scalars.cited_ids(F.col("answer")), 1).alias("first_cited"), F.size(scalars.cited_ids(F.col("answer"))).cast("long").alias("n_cited")).distinct()


@query("""
WITH m AS (SELECT *, CASE kind WHEN 'person' THEN 'Identity' WHEN 'place' THEN 'Identity' WHEN 'relationship' THEN 'People' WHEN 'event' THEN 'Timeline' WHEN 'habit' THEN 'Habits' WHEN 'preference' THEN 'Preferences' END AS section,
  CASE kind WHEN 'place' THEN 1 ELSE 0 END AS kind_no, CASE kind WHEN 'event' THEN coalesce(happened_at, '') ELSE '' END AS when_at FROM (SELECT DISTINCT id, kind, happened_at, created_at FROM facts))
SELECT id, section, row_number() OVER (PARTITION BY section ORDER BY kind_no, when_at, created_at, id) AS section_rank FROM m WHERE section IS NOT NULL""")
def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").select("id", "kind", "happened_at", "created_at").distinct()
    return fx.by_section(f).select("id", "section", "section_rank")


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events""")
def apple_epoch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    raw = F.when(F.col("event_id") % 2 == 0, (F.col("us") - 978_307_200_000_000) * 1000).otherwise(F.floor(F.col("us") / 1_000_000) - 978_307_200)
    return e.select("event_id", F.unix_micros(scalars.apple_timestamp(raw)).alias("us"))


@query("""
SELECT DISTINCT id, media_path, regexp_matches(replace(p, chr(92), '/'), '^[/~]|^[A-Za-z]:|(^|/)\\.\\.(/|$)') AS unsafe
FROM (SELECT id, media_path, CASE WHEN ord(id) % 4 = 0 THEN '/etc/' || media_path WHEN ord(id) % 4 = 1 THEN 'a/../' || media_path WHEN ord(id) % 4 = 2 THEN 'C:' || media_path ELSE media_path END AS p FROM raw_items WHERE media_path IS NOT NULL)""")
def unsafe_path(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_items").where("media_path is not null")
    k = F.ascii("id") % 4
    p = F.when(k == 0, F.concat(F.lit("/etc/"), "media_path")).when(k == 1, F.concat(F.lit("a/../"), "media_path")).when(k == 2, F.concat(F.lit("C:"), "media_path")).otherwise(F.col("media_path"))
    return r.select("id", "media_path", scalars.unsafe_media_path(p).alias("unsafe")).distinct()


@query("SELECT o_orderkey, sha1('AppDomain-' || o_orderpriority || '-' || CAST(o_orderkey AS VARCHAR)) AS file_id FROM orders")
def backup_file_ids(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", identity.backup_file_id(F.lit("AppDomain"), path).alias("file_id"))
