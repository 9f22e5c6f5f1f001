"""Registered queries of the llm operators: name -> callable, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import conversations, copies, encoding, names, packing, sentences, tokens
from quillon.session import settle_table, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(table(spark, d, "facts"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "facts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "raw_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.found(table(spark, d, "raw_items"), table(spark, d, "exports"))


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.sessions(table(spark, d, "raw_items"), table(spark, d, "exports"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "entities"), table(spark, d, "raw_items"), table(spark, d, "exports"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.found(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "context_budgets"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: documents, tokens of the whole, and what must not occur: containers over capacity, parts of
    documents that would fit whole, documents with a gap or a wrong size."""
    docs, budgets = table(spark, d, "documents"), table(spark, d, "context_budgets")
    packed = settle_table(packing.containers(docs, budgets), "packed")
    over = packed.groupBy("budget_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n")).groupBy("budget_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over"))
    each = packed.groupBy("budget_name", "capacity_tokens", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("part").alias("numbers"))
    sizes = docs.select("doc_id", F.size(tokens.token_ids(docs)).cast("long").alias("size"))
    judged = each.join(sizes, "doc_id").groupBy("budget_name").agg(
        F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("needlessly_split"),
        F.count_if((F.col("n") != F.col("size")) | (F.col("end") != F.col("size")) | (F.col("numbers") != F.col("parts"))).alias("incomplete"),
    )
    return judged.join(over, "budget_name").select("budget_name", "documents", "over", "needlessly_split", "incomplete")


_UNSEEN = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per document: the visible characters that its sentences cover, and whether any overlap or begin or end blank."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = sentences.split(table(spark, d, "documents"))
    made = spans.join(docs, "doc_id").withColumn("sentence", F.substr("text", F.col("sent_start").cast("int") + 1, (F.col("sent_end") - F.col("sent_start")).cast("int")))
    order = Window.partitionBy("doc_id").orderBy("sent_start")  # the sentences of one document
    made = made.withColumn("overlaps", F.coalesce(F.lag("sent_end").over(order) > F.col("sent_start"), F.lit(False)))
    blank = F.col("sentence").rlike(f"^{_UNSEEN}|{_UNSEEN}$")
    return made.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", _UNSEEN, ""))).alias("visible"), F.max(F.col("overlaps") | blank).alias("faulty"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_collapsed, p4_found, p4_sessions, p5_found, p6_found, p7_ids, p8_containers, p8_fill, p8_invariants, p9_found, p9_coverage)}


def _plain_sql(x: str) -> str:
    """A statement without case, white space and punctuation; a mark between two digits is set apart and kept."""
    mark = r"[\p{P}=|~^`<>]"
    text = f"nfc_normalize(lower(nfc_normalize({x})))"
    for _ in range(2):  # 1.2.3 has marks that share a digit
        text = f"regexp_replace({text}, '(\\p{{Nd}})({mark})(\\p{{Nd}})', '\\1'||chr(57344)||'\\2\\3', 'g')"
    return f"replace(regexp_replace({text}, '('||chr(57344)||'.)|[\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\p{{Cs}}]+|{mark}', '\\1', 'g'), chr(57344), '')"


_FIELDS = "regexp_replace(nfc_normalize(statement), '(?i)(^|[;|,{\\n\\r\\t]|\\s\\|)[\\s\\p{P}]*?\\b(" + "|".join(copies.LABELS) + ")\\b[\"''\\s]*[:=]', chr(1)||'\\2'||chr(2), 'g')"
_VALUE = _plain_sql("substr(p, strpos(p, chr(2)) + 1)")
_COPIES = f"""
WITH s AS (SELECT id, statement, string_split({_FIELDS}, chr(1)) AS parts FROM facts WHERE id IS NOT NULL AND statement IS NOT NULL),
k AS (SELECT id, CASE WHEN len(parts) >= 3 AND regexp_full_match(parts[1], '[\\s\\p{{P}}|=]*') THEN array_to_string(list_sort(list_transform(parts[2:], lambda p: lower(split_part(p, chr(2), 1)) || chr(31) || {_VALUE})), chr(30))
  ELSE {_plain_sql("statement")} END AS key FROM s)
SELECT min(id) AS keep_id, count(DISTINCT id) AS copies FROM k WHERE key <> '' GROUP BY key"""

SQL: dict[str, str] = {
    "p2_collapsed": _COPIES,
    "p2_found": f"SELECT * FROM ({_COPIES}) WHERE copies >= 2",
    "p8_invariants": "SELECT budget_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS over, 0 AS needlessly_split, 0 AS incomplete FROM context_budgets WHERE capacity_tokens > 0",
    "p9_coverage": "SELECT doc_id, length(regexp_replace(text, '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', '', 'g')) AS visible, false AS faulty FROM documents WHERE length(regexp_replace(text, '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', '', 'g')) > 0",
}
