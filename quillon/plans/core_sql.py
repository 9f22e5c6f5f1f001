"""SQL twins of the core training-data queries, for the oracle comparison."""

_UUID = "regexp_replace(lower(trim({x})), '^urn:uuid:|[{{}}()\\-]', '', 'g')"


def _uuid(x: str) -> str:
    d = _UUID.format(x=x)
    return f"case when regexp_full_match({d}, '[0-9a-f]{{32}}') then {d}[1:8] || '-' || {d}[9:12] || '-' || {d}[13:16] || '-' || {d}[17:20] || '-' || {d}[21:32] else lower(trim({x})) end"


P3 = f"""
WITH parents AS (
  SELECT 'raw_items' AS ref_table, trim(id) AS k, min(ingested_at) AS first FROM raw_items WHERE id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'entities', {_uuid('id')}, min(created_at) FROM entities WHERE id IS NOT NULL GROUP BY ALL),
gone AS (
  SELECT DISTINCT table_name AS ref_table, CASE WHEN table_name = 'entities' THEN {_uuid('record_key')} ELSE trim(record_key) END AS k FROM tombstones),
refs AS (
  SELECT 'raw_items' AS ref_table, id AS fact_id, created_at, trim(r) AS ref_id FROM (SELECT id, created_at, unnest(provenance) AS r FROM facts)
  UNION ALL SELECT 'entities', id, created_at, {_uuid('r')} FROM (SELECT id, created_at, unnest(entity_ids) AS r FROM facts)),
one AS (
  SELECT ref_table, fact_id, ref_id, min(created_at) AS created_at FROM refs WHERE fact_id IS NOT NULL AND ref_id IS NOT NULL AND ref_id <> '' GROUP BY ALL)
SELECT one.ref_table, strftime(one.created_at, '%Y-%m') AS period, one.fact_id, one.ref_id,
  CASE WHEN p.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
FROM one LEFT JOIN parents p ON p.ref_table = one.ref_table AND p.k = one.ref_id
LEFT JOIN gone g ON g.ref_table = one.ref_table AND g.k = one.ref_id
WHERE p.k IS NULL OR p.first > one.created_at
"""

P3_BY_PERIOD = f"""
SELECT ref_table, period, state, count(*) AS n_refs, count(DISTINCT fact_id) AS n_facts FROM ({P3}) GROUP BY ALL
"""
