"""Queries of the store, its writes and reads, resolution joins, extraction, evaluation and photo selection: every one
calls the operator it stands for, on a store made in the session's shared folder, and has a SQL twin."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.operators import evals, extract, stats, windows
from quillon.operators import facts as fx
from quillon.operators.profile import section
from quillon.operators.store import Store
from quillon.session import scratch_path, table

QUERIES = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
LATER = NOW + timedelta(days=1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark, "store"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the table as an extractor delivers them, in the order of their creation."""
    f = table(spark, d, "facts").where("statement is not null and id is not null")
    return f.select(F.struct("created_at", "id", "updated_at").alias("seq"), "kind", "statement", "confidence", "happened_at", "entity_ids", "provenance")


_FIRST = "SELECT md5(statement) AS hash, kind, confidence, row_number() OVER (PARTITION BY statement ORDER BY created_at, id, updated_at) AS n FROM facts WHERE statement IS NOT NULL AND id IS NOT NULL"


@query(f"SELECT hash, kind, 'ADD' AS event, true AS returned FROM ({_FIRST}) WHERE n = 1")
def store_add_facts(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-ignore of all facts, twice: the second time adds nothing; each new fact has one history row, and every
    input row gets the id of the stored fact."""
    s = _store(spark)
    first = s.add_facts(_facts(spark, d), NOW)
    s.add_facts(_facts(spark, d), LATER)
    got = s.read("facts").join(s.read("fact_history").select(F.col("fact_id").alias("id"), "event"), "id").join(first.select("id").distinct().withColumn("returned", F.lit(True)), "id", "left")
    return got.select("hash", "kind", "event", "returned")


@query(f"""
SELECT hash, CASE WHEN right(hash, 1) IN ('0', '1') THEN 'habit' ELSE kind END AS kind, right(hash, 1) IN ('1', '2') AS expired, right(hash, 1) IN ('0', '1', '2') AS touched,
  CASE WHEN right(hash, 1) = '0' THEN 'UPDATE' WHEN right(hash, 1) IN ('1', '2') THEN 'EXPIRE' END AS event FROM ({_FIRST}) WHERE n = 1""")
def store_update_facts(spark: SparkSession, d: str) -> DataFrame:
    """Changes of kind, expiry, both, or nothing: null leaves a value as it is, an expired fact stays so."""
    s = _store(spark)
    s.add_facts(_facts(spark, d), NOW)
    last = F.substr("hash", F.lit(32))
    changes = s.read("facts").where(last.isin("0", "1", "2", "3")).select("id", F.when(last.isin("0", "1"), "habit").alias("kind"), F.when(last.isin("1", "2"), F.lit(LATER)).alias("invalid_at"))
    s.update_facts(changes, LATER)
    log = s.read("fact_history").where("event <> 'ADD'").select(F.col("fact_id").alias("id"), "event")
    return s.read("facts").join(log, "id", "left").select("hash", "kind", F.col("invalid_at").isNotNull().alias("expired"), (F.col("updated_at") > F.lit(NOW)).alias("touched"), "event")


@query(f"""
SELECT hash, f->>'kind' AS before, CASE WHEN right(hash, 1) = '0' THEN 'habit' END AS after, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, json_object('kind', kind) AS f FROM ({_FIRST})) WHERE n = 1 AND right(hash, 1) IN ('0', '2')""")
def store_history_json(spark: SparkSession, d: str) -> DataFrame:
    """The audit rows keep the whole fact before a change and the changed columns after it, as JSON."""
    s = _store(spark)
    s.add_facts(_facts(spark, d), NOW)
    last = F.substr("hash", F.lit(32))
    s.update_facts(s.read("facts").where(last.isin("0", "2")).select("id", F.when(last == "0", "habit").alias("kind"), F.when(last == "2", F.lit(LATER)).alias("invalid_at")), LATER)
    h = s.read("fact_history").where("event <> 'ADD'")
    before = F.from_json("prev", "hash string, kind string, confidence float")
    return h.select(before["hash"].alias("hash"), before["kind"].alias("before"), F.get_json_object("next", "$.kind").alias("after"), before["confidence"].cast("double").alias("confidence"))


_ENTITIES = "SELECT DISTINCT name, kind FROM entities WHERE name IS NOT NULL AND kind IS NOT NULL"


@query(f"""
SELECT e.name, e.kind, list_sort(list_distinct(['same'] || coalesce(a.more, []))) AS aliases FROM ({_ENTITIES}) e
LEFT JOIN (SELECT name, kind, list(DISTINCT x) AS more FROM (SELECT name, kind, unnest(aliases) AS x FROM entities) WHERE x IS NOT NULL GROUP BY ALL) a ON a.name = e.name AND a.kind = e.kind""")
def store_entities_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Upserts by (name, kind), twice; aliases added twice stand once."""
    s = _store(spark)
    e = table(spark, d, "entities").where("name is not null and kind is not null")
    rows = e.select(F.struct("created_at", "id").alias("seq"), "name", "kind")
    ids = s.upsert_entities(rows, NOW)
    s.upsert_entities(rows, LATER)
    more = e.select("name", "kind", F.explode("aliases").alias("alias")).where("alias is not null").join(ids, ["name", "kind"]).select(F.col("id").alias("entity_id"), "alias")
    every = ids.select(F.col("id").alias("entity_id"), F.lit("same").alias("alias"))
    s.add_aliases(more.unionByName(every))
    s.add_aliases(every)
    return s.read("entities").select("name", "kind", F.array_sort("aliases").alias("aliases"))


@query(f"""
WITH e AS ({_ENTITIES}) SELECT 'listed' AS what, name FROM e WHERE kind = 'person' UNION ALL SELECT 'found', min(name) FROM e WHERE kind = 'org' UNION ALL SELECT 'got', min(name) FROM e WHERE kind = 'place'""")
def store_entity_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Lists by kind, lookups by alias and by id."""
    s = _store(spark)
    e = table(spark, d, "entities").where("name is not null and kind is not null")
    ids = s.upsert_entities(e.select(F.struct("created_at", "id").alias("seq"), "name", "kind"), NOW)
    org = ids.where("kind = 'org'").orderBy("name").limit(1)
    s.add_aliases(org.select(F.col("id").alias("entity_id"), F.lit("the firm").alias("alias")))
    place = ids.where("kind = 'place'").orderBy("name").head(1)[0]["id"]
    parts = [s.list_entities("person").select(F.lit("listed").alias("what"), "name"), s.find_by_alias("the firm").select(F.lit("found").alias("what"), "name"), s.get_entity(place).select(F.lit("got").alias("what"), "name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_name AS mention, n_name AS entity_name, 'score ' || p_size AS evidence, p_size / 100.0 AS score FROM part JOIN nation ON n_nationkey = p_size WHERE p_partkey <> 1 AND p_size < 25")
def store_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Queued proposals with their evidence; a decided one is no longer pending, and its entity unchanged."""
    s = _store(spark)
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    rows = p.where("p_size < 25").select(F.col("p_partkey"), F.col("p_name").alias("mention"), F.col("p_size").cast("string").alias("entity_id"), F.concat(F.lit("score "), F.col("p_size").cast("string")).alias("evidence"), (F.col("p_size") / 100).alias("score"))
    # Two parts may share mention and entity: the first part stands apart so that it can be decided alone.
    s.add_proposals(rows.where("p_partkey <> 1"), NOW)
    s.add_proposals(p.where("p_partkey = 1").select(F.lit("decided").alias("mention"), F.lit("3").alias("entity_id"), F.lit(None).cast("string").alias("evidence"), F.lit(0.5).alias("score")), LATER)
    s.resolve_proposal(s.read("merge_proposals").where("mention = 'decided'").first()["id"], True)
    names = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    got = fx.pending_proposals(s.read("merge_proposals"), names)
    return got.select("mention", "entity_name", "evidence", F.round(F.col("score").cast("double"), 4).alias("score"))


_WINDOWS = "SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS window_hash, o_orderkey % 4 AS k FROM orders"


@query(f"""
SELECT 'pending' AS what, count(*) AS n FROM ({_WINDOWS}) WHERE k = 0 UNION ALL SELECT 'extracted', count(*) FROM ({_WINDOWS}) WHERE k IN (1, 3) UNION ALL SELECT 'gave_up', count(*) FROM ({_WINDOWS}) WHERE k = 2
UNION ALL SELECT 'cleared', count(*) FROM ({_WINDOWS}) WHERE k = 2 UNION ALL SELECT 'pending after', count(*) FROM ({_WINDOWS}) WHERE k IN (0, 2)""")
def store_window_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of windows: the first one stays, failed ones can be cleared and are pending again."""
    s = _store(spark)
    w = table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("window_hash"), (F.col("o_orderkey") % 4).alias("k"))
    s.mark_windows(w.where("k in (1, 3)"), "extracted", NOW)
    s.mark_windows(w.where("k in (2, 3)"), "gave_up", LATER)
    pending = [("pending", s.pending_windows(w).count())]
    skipped = [(r["outcome"], r["n"]) for r in s.skipped_windows(w).collect()]  # one row per outcome
    cleared = [("cleared", s.clear_given_up())]
    return spark.createDataFrame([*pending, *skipped, *cleared, ("pending after", s.pending_windows(w).count())], "what string, n long")


@query("SELECT 3 AS fact_count, '## People' || chr(10) || 'third' AS body, 'third' AS people")
def store_profile_versions(spark: SparkSession, d: str) -> DataFrame:
    """Profiles are kept as versions; readers get the latest and its sections."""
    s = _store(spark)
    for k, text in enumerate(("first", "second", "third"), 1):
        s.save_profile(f"## People\n{text}", k, NOW + timedelta(hours=k))
    return s.latest_profile().select("fact_count", "body").withColumn("people", F.lit(section(s, "people").strip()))


@query("SELECT count(*) AS items, sum(o_custkey) AS facts_created, max(o_orderkey) AS mentions FROM orders")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of the log of runs."""
    o = table(spark, d, "orders").agg(F.count("*").alias("items"), F.sum("o_custkey").alias("facts_created"), F.max("o_orderkey").alias("mentions")).first().asDict()
    path = scratch_path(spark, "runs")
    empty = dict.fromkeys("duration_s windows_processed windows_skipped_extracted windows_skipped_gave_up facts_added dedup_hits retries escalations give_ups".split(), 0) | {"duration_s": 0.0}
    for day in (2, 3, 1):
        stats.append_run(spark, path, {**empty, **(o if day == 3 else dict.fromkeys(o, 0)), "timestamp": f"2024-01-0{day}T00:00:00+00:00"})
    last = stats.last_run(spark, path)
    return spark.createDataFrame([tuple(last[c] for c in ("items", "facts_created", "mentions"))], "items long, facts_created long, mentions long")


_DISTINCT = "SELECT DISTINCT id, created_at, happened_at, nullif(regexp_extract(happened_at, '\\d{4}-\\d{2}-\\d{2}'), '') AS day FROM facts WHERE invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-01'"


@query(f"SELECT id, happened_at, row_number() OVER (ORDER BY day, created_at, id) AS place FROM (SELECT * FROM ({_DISTINCT}) ORDER BY created_at, id LIMIT 5000) WHERE day BETWEEN '2012-01-01' AND '2018-12-31'")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """The first 5,000 facts by creation, then those in the range, in the order of their first date."""
    f = table(spark, d, "facts").select("id", "created_at", "happened_at", "invalid_at", "kind").dropDuplicates(["id", "created_at", "happened_at", "invalid_at"])
    f = f.where(F.col("invalid_at").isNull() | (F.col("invalid_at") > F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))).dropDuplicates(["id", "created_at", "happened_at"])
    rows = fx.timeline(f, "2012-01-01", "2018-12-31", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).collect()  # 5,000 rows at most
    return spark.createDataFrame([(r["id"], r["happened_at"], k) for k, r in enumerate(rows, 1)], "id string, happened_at string, place long")


_PEOPLE = "(SELECT list(id) FROM (SELECT DISTINCT id FROM entities WHERE kind = 'person' AND ascii(id) % 2 = 0))"
_VECTORS = """WITH f AS (SELECT DISTINCT ON (id) id, entity_ids, happened_at, ascii(md5(id)) AS a, ascii(right(md5(id), 1)) AS b FROM facts ORDER BY id, updated_at),
v AS (SELECT *, round(list_cosine_similarity([CAST(a AS DOUBLE), CAST(b AS DOUBLE), 50.0], [60.0, 90.0, 10.0]), 6) AS similarity FROM f)"""


@query(f"""{_VECTORS} SELECT id, similarity FROM (SELECT * FROM v ORDER BY similarity DESC, id LIMIT 400)
WHERE list_has_any(entity_ids, {_PEOPLE}) AND nullif(regexp_extract(happened_at, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') >= '2010-01-01'""")
def search_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nearest facts first, then people and dates: fewer than the limit may remain. Vectors come from the ids' hashes."""
    f = windows.first_by_min(table(spark, d, "facts").select("id", "updated_at", "kind", "entity_ids", "happened_at", "invalid_at"), ["id"], ["updated_at"])
    h = F.md5("id")
    f = f.withColumn("embedding", F.array(F.ascii(h), F.ascii(F.substr(h, F.lit(32))), F.lit(50)).cast("array<float>"))
    people = [r[0] for r in table(spark, d, "entities").where((F.col("kind") == "person") & (F.ascii("id") % 2 == 0)).select("id").distinct().collect()]  # the people a question names
    return fx.search_memories(f, [60.0, 90.0, 10.0], people, "2010-01-01", None, 400).select("id", "similarity")


@query("""
WITH s AS (SELECT o_orderkey AS id, unnest([o_custkey % 7, o_orderkey % 11, 99]) AS m FROM orders)
SELECT id, list_sort(list_distinct(list('e' || (m // 2)))) AS entity_ids FROM s WHERE m < 8 GROUP BY id""")
def subject_links(spark: SparkSession, d: str) -> DataFrame:
    """Subjects through the mentions that were resolved; two mentions may be one entity, unresolved ones drop out."""
    o = table(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("id"), F.transform(F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 11, F.lit(99)), lambda m: F.concat(F.lit("m"), m.cast("string"))).alias("subjects"))
    mentions = spark.range(8).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("mention"), F.concat(F.lit("e"), F.floor(F.col("id") / 2).cast("string")).alias("entity_id"))
    return fx.link_subjects(facts, mentions)


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold facts whose patterns hit several extracted ones each, in any case, and extracted facts with repeats."""
    p = table(spark, d, "part")
    kind = F.concat(F.lit("k"), (F.col("p_partkey") % 40).cast("string"))
    group = (F.col("p_partkey") % 200 / 40).cast("int").cast("string")
    gold = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("seq"), kind.alias("kind"), F.array(F.concat(F.lit("^ITEM "), group, F.lit(r"\b")), F.lit("in .*stock$")).alias("must_match"))
    got = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("seq"), kind.alias("kind"), F.concat(F.lit("Item "), group, F.lit(" was "), F.when(F.col("p_partkey") % 5 == 0, "sold").otherwise("in good stock")).alias("statement"))
    return got, gold


_PAIRED = """
WITH p AS (SELECT p_partkey, 'k' || (p_partkey % 40) AS kind, (p_partkey % 200) // 40 AS g FROM part),
gold AS (SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY p_partkey) AS n FROM p WHERE p_partkey % 3 <> 0),
got AS (SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY p_partkey) AS n FROM p WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0),
pairs AS (SELECT gold.kind, gold.p_partkey AS gold_seq, got.p_partkey AS extracted_seq FROM gold JOIN got USING (kind, g, n))"""


@query(f"{_PAIRED} SELECT * FROM pairs")
def gold_matching(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one matching: each gold fact takes the first unused extracted one that all its patterns hit."""
    return evals.match(*_gold(spark, d))


@query(f"""{_PAIRED}, k AS (SELECT kind, (SELECT count(*) FROM gold WHERE gold.kind = x.kind) AS gold, (SELECT count(*) FROM p WHERE p_partkey % 4 <> 0 AND p.kind = x.kind) AS extracted, (SELECT count(*) FROM pairs WHERE pairs.kind = x.kind) AS matched FROM (SELECT DISTINCT kind FROM p) x)
SELECT kind, gold, extracted, matched, round(CASE WHEN extracted = 0 THEN 0 ELSE matched / extracted END, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE matched / gold END, 6) AS recall,
  round(CASE WHEN extracted + gold = 0 OR matched = 0 THEN 0 ELSE 2.0 * matched / (extracted + gold) END, 6) AS f1 FROM k WHERE gold + extracted > 0""")
def extraction_eval(spark: SparkSession, d: str) -> DataFrame:
    got, gold = _gold(spark, d)
    s = evals.scores(got, gold, evals.match(got, gold))
    return s.select("kind", "gold", "extracted", "matched", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{_PAIRED} SELECT 'miss' AS what, p_partkey AS seq FROM gold WHERE p_partkey NOT IN (SELECT gold_seq FROM pairs) UNION ALL SELECT 'spurious', p_partkey FROM p WHERE p_partkey % 4 <> 0 AND p_partkey NOT IN (SELECT extracted_seq FROM pairs)")
def gold_misses(spark: SparkSession, d: str) -> DataFrame:
    got, gold = _gold(spark, d)
    pairs = evals.match(got, gold)
    return evals.misses(gold, pairs).select(F.lit("miss").alias("what"), "seq").unionByName(evals.spurious(got, pairs).select(F.lit("spurious").alias("what"), "seq"))


@query("SELECT round(avg(l_discount) + 0.8, 4) AS faithfulness, round(avg(l_tax) + 0.8, 4) AS relevancy, round(avg(l_quantity) / 60, 4) AS context_precision, avg(l_discount) + 0.8 >= 0.85 AND avg(l_tax) + 0.8 >= 0.8 AND avg(l_quantity) / 60 >= 0.7 AS passed FROM lineitem")
def answer_metric_means(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_discount") + 0.8).alias("faithfulness"), (F.col("l_tax") + 0.8).alias("relevancy"), (F.col("l_quantity") / 60).alias("context_precision"))
    m = evals.metric_means(li)
    return m.select(*(F.round(c, 4).alias(c) for c in ("faithfulness", "relevancy", "context_precision")), "passed")


def _attempts(prompt: str, escalated: bool) -> dict:
    """A model that fails once for keys divisible by 3, until the stronger one is asked for those by 5, always for 7."""
    key = int(prompt.split()[1])
    again = "not usable" in prompt
    if key % 7 == 0 or (key % 5 == 0 and not escalated) or (key % 3 == 0 and not again):
        raise ValueError("no answer")
    return {"facts": [{"kind": "event", "statement": f"fact {k} of {key}", "confidence": 0.5, "subjects": [f"s{key % 4}"]} for k in range(key % 3)], "notes": None}


_TRIED = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS attempt, c_custkey % 7 = 0 AS gave_up FROM customer"


def _results(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    w = table(spark, d, "customer").select(F.lit("g").alias("source_group"), F.sha2(key, 256).alias("window_hash"), F.array(key).alias("provenance"), F.concat(F.lit("window "), key, F.lit(" text")).alias("transcript"))
    return extract.extract(w, _attempts)


@query(f"SELECT count(*) AS windows, sum(attempt - 1) AS retries, count(*) FILTER (attempt = 3) AS escalations, count(*) FILTER (gave_up) AS give_ups, sum(CASE WHEN gave_up THEN 0 ELSE k % 3 END) AS facts FROM ({_TRIED})")
def extraction_counters(spark: SparkSession, d: str) -> DataFrame:
    """Retries, escalations and windows given up; an empty list is a success."""
    return extract.counters(_results(spark, d))


@query(f"SELECT sha256(CAST(k AS VARCHAR)) AS window_hash, 'fact ' || n || ' of ' || k AS statement, CAST(k AS VARCHAR) AS item, 's' || (k % 4) AS subject, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM (SELECT *, unnest(range(k % 3)) AS n FROM ({_TRIED}) WHERE NOT gave_up)")
def extraction_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per fact, with the items of its window, in window order."""
    f = extract.flattened(_results(spark, d))
    place = F.col("seq") - F.min("seq").over(_by("window_hash")) + 1
    return f.select("window_hash", "statement", F.col("provenance")[0].alias("item"), F.col("subjects")[0].alias("subject"), place.cast("long").alias("place"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)  # the facts of one window


_LINE = "'[' || coalesce(c_name, 'SYSTEM') || ' @ ' || coalesce(strftime(make_timestamp(1500000000000000 + o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S'), 'unknown') || ']: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' OCR: a | ' || o_orderkey ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' tags: food, pet' ELSE '' END"


@query(f"""
SELECT string_agg({_LINE}, chr(10) ORDER BY o_orderkey) AS transcript, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS provenance, sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey)) AS window_hash
FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS chunk FROM orders) LEFT JOIN customer ON c_custkey = o_custkey AND o_custkey % 5 <> 0 GROUP BY o_custkey, chunk""")
def window_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three items with their transcript: sender or SYSTEM, time, text, text lines and tags of photos."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 5 <> 0")
    key = F.col("o_orderkey")
    meta = F.to_json(F.struct(F.when(key % 2 == 0, F.array(F.lit("a"), key.cast("string"))).alias("ocr_lines"), F.when(key % 3 == 0, F.array(F.lit("food"), F.lit("pet"))).alias("vision_tags")))
    items = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        key.cast("string").alias("id"), F.lit("sms").alias("source"), F.timestamp_seconds(key + 1_500_000_000).alias("ts"), F.col("c_name").alias("sender"), F.col("o_orderpriority").alias("text"), meta.alias("meta"),
        F.col("o_custkey").cast("string").alias("source_group"), key.alias("seq"),
    )
    return extract.window_transcripts(items, 3, 10**9).select("transcript", "provenance", "window_hash")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'people' WHEN p_size % 3 = 1 THEN 'receipt' ELSE 'food' END AS best, CASE p_size % 3 WHEN 0 THEN ['people', 'food', 'pet'] WHEN 1 THEN ['receipt', 'people', 'pet'] ELSE ['food', 'pet', 'people'] END AS top, CASE p_size % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.25 END AS score FROM part""")
def photo_tags(spark: SparkSession, d: str) -> DataFrame:
    """The best label, the three best, and how much a photo tells; ties go by the order of labels, or by name."""
    k = F.col("p_size") % 3
    tags = F.when(k == 0, F.create_map(*_pairs(food=0.75, people=0.75, pet=0.25))).when(k == 1, F.create_map(*_pairs(receipt=0.75, people=0.5, pet=0.25))).otherwise(F.create_map(*_pairs(pet=0.5, food=0.75, people=0.25)))
    p = table(spark, d, "part").withColumn("tags", tags)
    # Equal scores go by name where labels are listed, so a tie of the best is settled by their own order.
    top = scalars.top_labels(F.col("tags"))
    ordered = F.when(k == 0, F.concat(F.slice(top, 2, 1), F.slice(top, 1, 1), F.slice(top, 3, 1))).otherwise(top)
    return p.select("p_partkey", scalars.best_label(F.col("tags")).alias("best"), ordered.alias("top"), scalars.combined_score(F.col("tags")).alias("score"))


def _pairs(**scores: float) -> list:
    return [F.lit(x) for pair in scores.items() for x in pair]


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY round, month) AS place FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, o_orderkey) AS round
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS month, (o_custkey % 64) / 64.0 AS score FROM orders WHERE NOT (o_orderkey % 4 = 0 AND (o_custkey % 64) / 64.0 < 0.75))) ORDER BY round, month LIMIT 300""")
def photo_selection(spark: SparkSession, d: str) -> DataFrame:
    """Photos for a closer look: none whose best label shows nobody, months in turn, undated ones in one of their own."""
    o = table(spark, d, "orders")
    people = (F.col("o_custkey") % 64 / 64).cast("float")
    tags = F.create_map(F.lit("people"), people, F.lit("screenshot"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.75)).otherwise(F.lit(-1.0)).cast("float"))
    photos = o.select(F.col("o_orderkey").alias("seq"), tags.alias("tags"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate").cast("timestamp")).alias("taken"))
    rows = windows.select_for_vision(photos, 300).select("seq").collect()  # at most the cap
    return spark.createDataFrame([(r["seq"], k) for k, r in enumerate(rows, 1)], "o_orderkey long, place long")


@query("SELECT c_custkey, round((c_custkey % 90 + (c_custkey % 60) / 60.0 + 30 / 3600.0) * CASE WHEN c_nationkey % 4 IN (0, 1) THEN -1 ELSE 1 END, 9) AS degrees FROM customer")
def dms_degrees(spark: SparkSession, d: str) -> DataFrame:
    ref = F.element_at(F.array(F.lit("S"), F.lit("w"), F.lit("N"), F.lit("E")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.round(scalars.dms_to_decimal(F.col("c_custkey") % 90, F.col("c_custkey") % 60, F.lit(30), ref), 9).alias("degrees"))


@query("SELECT vec_id, round(1 / (1 + exp(-(CAST(embedding[1] AS DOUBLE) * 10 - 1))), 6) AS score, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def tagger_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sigmoid scores and unit vectors, as an image tagger makes them of embeddings."""
    e = table(spark, d, "embeddings")
    unit = F.transform(scalars.l2_normalize(F.col("embedding")), lambda x: F.round(x, 6))
    return e.select("vec_id", F.round(scalars.sigmoid_score(F.col("embedding")[0].cast("double"), F.lit(10.0), F.lit(-1.0)), 6).alias("score"), unit.alias("unit"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'b' ELSE NULL END AS found FROM nation")
def profile_section_text(spark: SparkSession, d: str) -> DataFrame:
    """The block under a heading, in any case; the last one, a middle one, none."""
    n = table(spark, d, "nation")
    text = F.concat(F.lit("## One\nb\n\n## TWO \n"), "n_name", F.lit("\n"))
    name = F.element_at(F.array(F.lit("two"), F.lit("one"), F.lit("three")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", scalars.extract_section(text, name).alias("found"))


@query("""
SELECT r.m, list_sort(list(r.e)) AS hits FROM (SELECT a.n_nationkey AS m, b.n_nationkey AS e FROM nation a JOIN nation b ON lower(a.n_name) = lower(b.n_name) OR (a.n_regionkey = b.n_nationkey)) r GROUP BY r.m""")
def exact_tier(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that equal a name or an alias after normalisation; an empty mention matches nothing."""
    n = table(spark, d, "nation")
    mentions = n.select(F.col("n_nationkey").alias("m"), scalars.normalize_name(F.concat(F.lit("  "), F.upper("n_name"))).alias("mention"), F.col("n_regionkey")).unionByName(n.where("n_nationkey = 0").select(F.lit(-1).cast("int").alias("m"), F.lit("").alias("mention"), F.col("n_regionkey")))
    by_region = n.select("n_regionkey", scalars.normalize_name(F.col("n_name")).alias("alias"))
    aliases = by_region.groupBy(F.col("n_regionkey").alias("e")).agg(F.collect_list("alias").alias("aliases"))  # nations of a region
    names = n.select(F.col("n_nationkey").alias("e"), scalars.normalize_name(F.col("n_name")).alias("name")).join(aliases, "e", "left")
    hit = mentions.join(names, scalars.exact_match(F.col("mention"), F.col("name"), F.col("aliases")))  # 25 names
    return hit.groupBy("m").agg(F.array_sort(F.collect_list("e")).alias("hits"))


class _Fixed:
    """An embedder whose queries have known vectors."""

    def embed_query(self, text: str) -> list[float]:
        return {"a": [60.0, 90.0, 10.0], "b": [100.0, 50.0, 90.0]}[text]


def _with_vectors(spark: SparkSession, d: str) -> Store:
    s = _store(spark)
    h = F.md5("statement")
    s.add_facts(_facts(spark, d).withColumn("embedding", F.array(F.ascii(h), F.ascii(F.substr(h, F.lit(32))), F.lit(50)).cast("array<float>")), NOW)
    return s


_UUID = "substr(md5({h}),1,8)||'-'||substr(md5({h}),9,4)||'-'||substr(md5({h}),13,4)||'-'||substr(md5({h}),17,4)||'-'||substr(md5({h}),21,12)"


@query(f"""
WITH v AS (SELECT DISTINCT md5(statement) AS h, ascii(md5(statement)) AS a, ascii(right(md5(statement), 1)) AS b FROM facts WHERE statement IS NOT NULL AND id IS NOT NULL),
f AS (SELECT {_UUID.format(h="h")} AS id, a, b FROM v),
q AS (SELECT 0 AS no, [60.0, 90.0, 10.0] AS x UNION ALL SELECT 1, [100.0, 50.0, 90.0]),
r AS (SELECT no, id, row_number() OVER (PARTITION BY no ORDER BY round(list_cosine_similarity([CAST(a AS DOUBLE), CAST(b AS DOUBLE), 50.0], x), 6) DESC, id) AS rank FROM f, q)
SELECT id, row_number() OVER (ORDER BY no, rank) AS place FROM (SELECT id, min(no) AS no, arg_min(rank, no) AS rank FROM r WHERE rank <= 5 GROUP BY id)""")
def multi_query_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest facts of each sub-question, each fact once, in the order of first sight."""
    from quillon.models.offline import Models
    from quillon.operators.answer import retrieve

    rows = retrieve(_with_vectors(spark, d), ["a", "b"], Models(embedder=_Fixed())).collect()  # five rows a query
    return spark.createDataFrame([(r["id"], k) for k, r in enumerate(rows, 1)], "id string, place long")


@query(f"""
WITH f AS (SELECT kind, statement, happened_at, {_UUID.format(h="hash")} AS id FROM (SELECT kind, statement, happened_at, md5(statement) AS hash, row_number() OVER (PARTITION BY statement ORDER BY created_at, id, updated_at) AS n FROM facts WHERE statement IS NOT NULL AND id IS NOT NULL) WHERE n = 1),
m AS (SELECT *, CASE kind WHEN 'person' THEN 1 WHEN 'place' THEN 1 WHEN 'relationship' THEN 2 WHEN 'event' THEN 3 WHEN 'habit' THEN 4 WHEN 'preference' THEN 5 END AS no FROM f),
s AS (SELECT no, string_agg(rtrim(regexp_replace(statement, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '.') || ' [fact:' || substr(id, 1, 8) || '].', chr(10) ORDER BY CASE kind WHEN 'place' THEN 1 ELSE 0 END, CASE kind WHEN 'event' THEN coalesce(happened_at, '') ELSE '' END, id) AS body FROM m WHERE no IS NOT NULL GROUP BY no)
SELECT (SELECT count(*) FROM f) AS fact_count, md5(string_agg('## ' || ['Identity', 'People', 'Timeline', 'Habits', 'Preferences'][no] || chr(10) || body, chr(10) || chr(10) ORDER BY no)) AS body_md5, false AS again FROM s""")
def profile_document(spark: SparkSession, d: str) -> DataFrame:
    """A profile of all facts in its sections, one cited sentence each; a second run saves no new version."""
    from quillon.models.offline import plain_sentences
    from quillon.operators.profile import synthesize

    s = _store(spark)
    s.add_facts(_facts(spark, d), NOW)
    synthesize(s, lambda statements: [x.strip() for x in plain_sentences([x.strip() for x in statements])], LATER)
    again = synthesize(s, plain_sentences, LATER + timedelta(hours=1))
    return s.latest_profile().select(F.col("fact_count").cast("long").alias("fact_count"), F.md5("body").alias("body_md5"), F.lit(again).alias("again"))


@query("""
SELECT upper(n_name) AS mention, n_name AS entity, 'known' AS how FROM nation UNION ALL SELECT 'face:7', min(n_name), 'known' FROM nation UNION ALL SELECT 'qz' || s_suppkey || ' wx' || (s_suppkey * 7919), 'qz' || s_suppkey || ' wx' || (s_suppkey * 7919), 'new' FROM supplier WHERE s_suppkey < 60""")
def mention_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that equal a known name, a label of a face, and names that nobody bears yet, which become people."""
    from quillon.models.offline import BagEmbedder, name_judge
    from quillon.operators.extract import embed
    from quillon.operators.resolve import resolve

    s, embedder = _store(spark), BagEmbedder(1 << 14)
    n = table(spark, d, "nation")
    s.upsert_entities(embed(n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), F.lit("place").alias("kind")), "name", embedder), NOW)
    s.add_aliases(s.read("entities").orderBy("name").limit(1).select(F.col("id").alias("entity_id"), F.lit("face:7").alias("alias")))
    known = n.select(F.upper("n_name").alias("mention")).unionByName(spark.createDataFrame([("face:7",), ("face:8",)], "mention string"))
    new = table(spark, d, "supplier").where("s_suppkey < 60").select(F.concat(F.lit("qz"), F.col("s_suppkey").cast("string"), F.lit(" wx"), (F.col("s_suppkey") * 7919).cast("string")).alias("mention"))
    done = resolve(s, known.unionByName(new), embedder, name_judge, LATER)
    entities = s.read("entities").select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), F.when(F.col("kind") == "person", "new").otherwise("known").alias("how"))
    return done.join(entities, "entity_id").select("mention", "entity", "how")


_LIKES = "'Ann' || (s_suppkey % 30) || ' likes tea ' || (s_suppkey % 50)"


@query(f"""
SELECT count(*) AS items, CAST(ceil(count(*) / 40) AS BIGINT) AS windows_processed, count(*) AS facts_created, count(DISTINCT {_LIKES}) AS facts_added, count(*) - count(DISTINCT {_LIKES}) AS dedup_hits, 0 AS retries, 0 AS give_ups,
  0 AS windows_skipped, count(DISTINCT 'Ann' || (s_suppkey % 30)) AS mentions FROM supplier""")
def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over a corpus folder: read, window, extract, store, resolve, link, profile; its run record."""
    from quillon.cli import Settings, run_pipeline
    from quillon.models.offline import BagEmbedder, Models
    from quillon.session import shared_file_dir

    root = shared_file_dir(spark, "corpus")
    (root / "whatsapp").mkdir()
    lines = table(spark, d, "supplier").orderBy("s_suppkey").selectExpr("concat('1/15/25, 10:32:07 AM - Bo: Ann', s_suppkey % 30, ' likes tea ', s_suppkey % 50) AS line")
    with (root / "whatsapp" / "tea.txt").open("w") as f:
        f.writelines(r["line"] + "\n" for r in lines.toLocalIterator())
    s = _store(spark)
    record = run_pipeline(s, Settings(store=s.root, corpus=str(root), source_tz="UTC"), Models(embedder=BagEmbedder(1 << 12)))
    record["windows_skipped"] = record["windows_skipped_extracted"] + record["windows_skipped_gave_up"]
    names = ("items", "windows_processed", "facts_created", "facts_added", "dedup_hits", "retries", "give_ups", "windows_skipped", "mentions")
    return spark.createDataFrame([tuple(int(record[c]) for c in names)], ", ".join(f"{c} long" for c in names))


@query("SELECT DISTINCT id, 1 AS copies FROM raw_items WHERE id IS NOT NULL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A stream of items into the store, twice over the same files: repeated deliveries add nothing."""
    from quillon.streaming.ingest import ingest

    raw = table(spark, d, "raw_items")
    path = scratch_path(spark, "arriving")
    raw.repartition(4).write.parquet(path)
    s = _store(spark)
    for _ in range(2):
        items = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(path)
        items = items.select("id", "source", F.col("ingested_at").cast("timestamp").alias("ts"), "sender", F.col("body").alias("text"), "media_path", "is_system", "meta", F.col("export_id").alias("source_group"), F.lit(0).cast("long").alias("seq"))
        ingest(items, s, scratch_path(spark, "offsets")).awaitTermination()
    return s.read("raw_items").groupBy("id").agg(F.count("*").alias("copies"))


@query(f"SELECT DISTINCT {_LIKES} AS statement, true AS has_vector, 2 AS windows_then, 0 AS windows_again FROM supplier WHERE s_suppkey < 60")
def stream_extract(spark: SparkSession, d: str) -> DataFrame:
    """Items as they arrive: windows without an outcome are extracted, their facts get vectors; a second pass finds
    no window left."""
    from quillon.models.offline import rule_extractor
    from quillon.streaming.ingest import extract_new_windows

    k = F.col("s_suppkey")
    text = F.concat(F.lit("Ann"), (k % 30).cast("string"), F.lit(" likes tea "), (k % 50).cast("string"))
    items = table(spark, d, "supplier").where("s_suppkey < 60").select(
        k.cast("string").alias("id"), F.lit("sms").alias("source"), F.timestamp_seconds(k).alias("ts"), F.lit("Bo").alias("sender"), text.alias("text"), F.lit(None).cast("string").alias("media_path"),
        F.lit(False).alias("is_system"), F.lit("{}").alias("meta"), F.lit("g").alias("source_group"), k.alias("seq"),
    )
    s = _store(spark)
    first = extract_new_windows(items, s, rule_extractor, now=NOW)["windows"]
    again = extract_new_windows(items, s, rule_extractor, now=LATER)["windows"]
    return s.read("facts").select("statement", (F.size("embedding") > 0).alias("has_vector"), F.lit(first).cast("int").alias("windows_then"), F.lit(again).cast("int").alias("windows_again"))


@query(f"""
SELECT (SELECT count(*) FROM ({_FIRST}) WHERE n = 1) AS facts, (SELECT count(*) FROM ({_ENTITIES})) AS entities, (SELECT count(*) FROM nation) AS pending, (SELECT count(*) FROM ({_FIRST}) WHERE n = 1) AS added, (SELECT count(DISTINCT id) FROM raw_items WHERE lower(source) = 'sms') AS sms""")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a store in one shape."""
    s = _store(spark)
    s.add_facts(_facts(spark, d), NOW)
    e = table(spark, d, "entities").where("name is not null and kind is not null")
    s.upsert_entities(e.select(F.struct("created_at", "id").alias("seq"), "name", "kind"), NOW)
    s.add_proposals(table(spark, d, "nation").select(F.col("n_name").alias("mention"), F.col("n_name").alias("entity_id"), F.lit(0.5).alias("score")), NOW)
    s.add_raw_items(table(spark, d, "raw_items").where("lower(source) = 'sms'").select("id", F.lower("source").alias("source"), F.lit(0).alias("seq")))
    got = stats.stats(s)
    row = (got["facts"]["total"], got["entities"], got["confirm_queue"]["pending"], got["fact_history_events"]["ADD"], got["raw_items_by_source"]["sms"])
    return spark.createDataFrame([row], "facts long, entities long, pending long, added long, sms long")


@query("SELECT DISTINCT id, kind, statement, invalid_at FROM facts")
def fact_projection(spark: SparkSession, d: str) -> DataFrame:
    """The columns that readers of facts get; embedding, body and history stay behind."""
    rows = fx.fact_columns(table(spark, d, "facts"))
    assert "body" not in rows.columns and "hash" not in rows.columns
    return rows.select("id", "kind", "statement", "invalid_at").distinct()
