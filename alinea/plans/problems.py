"""Queries of the general problems (2: orphan references, 3: nested records) over the tables of a data folder."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.functions.keys import norm_key
from alinea.operators.nested import bridge, flatten_judgments, merkle_objects, shred, unread
from alinea.operators.orphans import orphan_report, orphans, with_reason
from alinea.plans.stage import staged
from alinea.plans.unions import union_all
from alinea.sources.tables import table


def _reference(df: DataFrame, src_table: str, src_field: str, record_id: str | None, ref_table: str, ref_key: str, at: str, own: tuple[str, str, str] | None = None) -> DataFrame:
    own_key, own_from, own_to = (norm_key(own[0]), F.col(own[1]), F.col(own[2])) if own else (F.lit(None).cast("string"), *[F.lit(None).cast("timestamp_ntz")] * 2)
    return df.select(
        F.lit(src_table).alias("src_table"),
        F.lit(src_field).alias("src_field"),
        (F.col(record_id) if record_id else F.lit(None)).cast("bigint").alias("record_id"),
        F.lit(ref_table).alias("ref_table"),
        norm_key(ref_key).alias("ref_key"),
        F.col(at).alias("at"),
        own_key.alias("own_key"),
        own_from.alias("own_from"),
        own_to.alias("own_to"),
    )


def _references(spark: SparkSession, d: str) -> DataFrame:
    """References of findings and reviews, and those of clauses and controls to their parents."""
    findings, review = table(spark, d, "findings_sample"), table(spark, d, "review")
    clauses, controls = table(spark, d, "clauses"), table(spark, d, "controls")
    refs = [
        _reference(findings.select("line_no", "judged_at", F.explode("findings.control_id").alias("k")), "findings_sample", "findings.control_id", "line_no", "controls", "k", "judged_at"),
        _reference(findings.select("line_no", "judged_at", F.explode("offered").alias("k")), "findings_sample", "offered", "line_no", "controls", "k", "judged_at"),
        _reference(review, "review", "clause_id", "review_id", "clauses", "clause_id", "reviewed_at"),
        _reference(clauses, "clauses", "parent_id", None, "clauses", "parent_id", "loaded_at", ("clause_id", "loaded_at", "retired_at")),
        _reference(controls, "controls", "parent_id", None, "controls", "parent_id", "loaded_at", ("control_id", "loaded_at", "withdrawn_at")),
    ]
    return union_all(refs)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The spans in which clauses and controls hold."""
    spans = [
        table(spark, d, t).select(F.lit(t).alias("ref_table"), norm_key(key).alias("key"), F.col("loaded_at").alias("valid_from"), F.col(ended).alias("valid_to"))
        for t, key, ended in (("clauses", "clause_id", "retired_at"), ("controls", "control_id", "withdrawn_at"))
    ]
    return union_all(spans)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Direct orphans among the references of findings_sample and review, each combination once."""
    found = orphans(_references(spark, d), _targets(spark, d)).where((F.col("kind") == "direct") & F.col("src_table").isin("findings_sample", "review"))
    return found.select("src_table", "src_field", "record_id", "ref_key").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of all five references per table, field and month, with why the direct ones are."""
    targets = _targets(spark, d)
    return orphan_report(with_reason(orphans(_references(spark, d), targets), targets))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "findings_raw").select(F.lit("findings_raw").alias("src_table"), "line_no", "payload")
    sample = table(spark, d, "findings_sample").select(F.lit("findings_sample").alias("src_table"), "line_no", F.to_json(F.struct("clause_id", "findings")).alias("payload"))
    return union_all([raw, sample])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Judgments and debate rounds of findings_sample and findings_raw as flat rows."""
    return flatten_judgments(staged(shred(_documents(spark, d), canonical=False), "occurrences"))


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct object and array once, with its number of occurrences."""
    return merkle_objects(shred(_documents(spark, d)))


def p3_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of an object or array with its way to its parent: with p3_objects the documents again."""
    return bridge(shred(_documents(spark, d), canonical=False))


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """How many objects and arrays each line has."""
    return p3_bridge(spark, d).groupBy("src_table", "line_no").agg(F.count_if(F.col("kind") == "object").alias("n_objects"), F.count_if(F.col("kind") == "array").alias("n_arrays"))


def p3_unread(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that give no rows, or not all, and why."""
    return unread(shred(_documents(spark, d), canonical=False))


P2_SQL = """
WITH refs AS (
  SELECT 'findings_sample' AS src_table, 'findings.control_id' AS src_field, line_no AS record_id, f.control_id AS k, judged_at AS seen_at
  FROM (SELECT line_no, judged_at, unnest(findings) AS f FROM findings_sample)
  UNION ALL SELECT 'findings_sample', 'offered', line_no, o, judged_at FROM (SELECT line_no, judged_at, unnest(offered) AS o FROM findings_sample)
  UNION ALL SELECT 'review', 'clause_id', review_id, clause_id, reviewed_at FROM review),
keyed AS (SELECT src_table, src_field, CAST(record_id AS BIGINT) AS record_id, upper(trim(k)) AS ref_key, seen_at FROM refs WHERE trim(k) <> ''),
spans AS (
  SELECT 'findings_sample' AS src_table, upper(trim(control_id)) AS ref_key, loaded_at AS a, withdrawn_at AS b FROM controls
  UNION ALL SELECT 'review', upper(trim(clause_id)), loaded_at, retired_at FROM clauses)
SELECT DISTINCT src_table, src_field, record_id, ref_key FROM keyed k
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.src_table = k.src_table AND s.ref_key = k.ref_key AND s.a <= k.seen_at AND (s.b IS NULL OR s.b > k.seen_at))
"""


P2_REPORT_SQL = """
WITH RECURSIVE lines AS (
  SELECT 'findings_sample' AS src_table, 'findings.control_id' AS src_field, line_no AS record_id, 'controls' AS ref_table, f.control_id AS k, judged_at AS seen_at, NULL::VARCHAR AS own_key, NULL::TIMESTAMP AS own_from, NULL::TIMESTAMP AS own_to
  FROM (SELECT line_no, judged_at, unnest(findings) AS f FROM findings_sample)
  UNION ALL SELECT 'findings_sample', 'offered', line_no, 'controls', o, judged_at, NULL, NULL, NULL FROM (SELECT line_no, judged_at, unnest(offered) AS o FROM findings_sample)
  UNION ALL SELECT 'review', 'clause_id', review_id, 'clauses', clause_id, reviewed_at, NULL, NULL, NULL FROM review
  UNION ALL SELECT 'clauses', 'parent_id', NULL, 'clauses', parent_id, loaded_at, nullif(upper(trim(clause_id)), ''), loaded_at, retired_at FROM clauses
  UNION ALL SELECT 'controls', 'parent_id', NULL, 'controls', parent_id, loaded_at, nullif(upper(trim(control_id)), ''), loaded_at, withdrawn_at FROM controls),
refs AS (SELECT DISTINCT * EXCLUDE (k), upper(trim(k)) AS ref_key FROM lines WHERE trim(k) <> ''),
spans AS (
  SELECT 'controls' AS tab, upper(trim(control_id)) AS key, loaded_at AS a, withdrawn_at AS b FROM controls
  UNION ALL SELECT 'clauses', upper(trim(clause_id)), loaded_at, retired_at FROM clauses),
direct AS (SELECT r.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM spans s WHERE s.tab = r.ref_table AND s.key = r.ref_key) THEN 'never there'
    WHEN EXISTS (SELECT 1 FROM spans s WHERE s.tab = r.ref_table AND s.key = r.ref_key AND s.a <= r.seen_at) THEN 'ended'
    WHEN seen_at IS NOT NULL THEN 'not yet there' END AS reason
  FROM refs r WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.tab = r.ref_table AND s.key = r.ref_key AND s.a <= r.seen_at AND (s.b IS NULL OR s.b > r.seen_at))),
nodes AS (
  SELECT src_table AS tab, own_key AS key, own_from AS a, own_to AS b FROM direct WHERE own_key IS NOT NULL
  UNION SELECT r.src_table, r.own_key, r.own_from, r.own_to FROM nodes n JOIN refs r ON r.ref_table = n.tab AND r.ref_key = n.key AND n.a <= r.seen_at AND (n.b IS NULL OR n.b > r.seen_at) WHERE r.own_key IS NOT NULL),
found AS (
  SELECT src_table, src_field, record_id, own_key, seen_at, 'direct' AS kind, reason FROM direct
  UNION ALL SELECT src_table, src_field, record_id, own_key, seen_at, 'inherited', 'inherited' FROM refs r
    WHERE EXISTS (SELECT 1 FROM nodes n WHERE r.ref_table = n.tab AND r.ref_key = n.key AND n.a <= r.seen_at AND (n.b IS NULL OR n.b > r.seen_at)))
SELECT src_table, src_field, strftime(seen_at, '%Y-%m') AS month, count(*) FILTER (kind = 'direct') AS n_direct, count(*) FILTER (kind = 'inherited') AS n_inherited,
  count(*) FILTER (reason = 'never there') AS n_never_there, count(*) FILTER (reason = 'ended') AS n_ended, count(*) FILTER (reason = 'not yet there') AS n_not_yet_there,
  count(DISTINCT coalesce(CAST(record_id AS VARCHAR), own_key)) AS n_records
FROM found GROUP BY ALL
"""


P3_SQL = r"""
WITH raw AS (SELECT line_no, regexp_replace(payload, '^\s*```(json)?\s*|\s*```\s*$', '', 'g') AS t FROM findings_raw),
doc AS (SELECT line_no, CAST(t AS JSON) AS j FROM raw WHERE json_valid(t)),
lists AS (SELECT line_no, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j, '$.batch.records') = 'ARRAY' THEN CAST(j -> '$.batch.records' AS JSON[]) ELSE [j] END AS l FROM doc),
records AS (SELECT line_no, record_no, l[record_no] AS r FROM (SELECT line_no, l, unnest(range(1, len(l) + 1)) AS record_no FROM lists)),
held AS (SELECT line_no, record_no, coalesce(r ->> '$.clause_id', r ->> '$.clause.clause_id', '') AS clause_id, coalesce(r -> '$.findings', r -> '$.result.findings', r -> '$.result.judge.findings') AS f FROM records WHERE json_type(r) = 'OBJECT'),
opened AS (SELECT * REPLACE (CASE WHEN json_type(f) = 'VARCHAR' THEN CASE WHEN json_valid(f ->> '$') THEN CAST(f ->> '$' AS JSON) END ELSE f END AS f) FROM held),
found AS (SELECT line_no, record_no, clause_id, CASE json_type(f) WHEN 'ARRAY' THEN CAST(f AS JSON[]) WHEN 'OBJECT' THEN [f] ELSE [] END AS l FROM opened),
judged AS (SELECT line_no, record_no, clause_id, finding_no, l[finding_no] AS f FROM (SELECT *, unnest(range(1, len(l) + 1)) AS finding_no FROM found)),
debated AS (SELECT line_no, record_no, clause_id, finding_no, CASE json_type(d) WHEN 'ARRAY' THEN CAST(d AS JSON[]) WHEN 'OBJECT' THEN [d] ELSE [] END AS l
  FROM (SELECT *, coalesce(f -> '$.debate.rounds', f -> '$.rounds') AS d FROM judged WHERE json_type(f) = 'OBJECT')),
rounds AS (SELECT *, l[round_no] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS round_no FROM debated)),
flat AS (
  SELECT 'findings_raw' AS src_table, line_no, record_no, finding_no, 0 AS round_no, clause_id, f ->> '$.control_id' AS control_id, f ->> '$.relationship' AS relationship FROM judged WHERE json_type(f) = 'OBJECT'
  UNION ALL SELECT 'findings_raw', line_no, record_no, finding_no, round_no, clause_id, x ->> '$.ruling.control_id', x ->> '$.ruling.relationship' FROM rounds WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT 'findings_sample', line_no, 1, i, 0, coalesce(clause_id, ''), findings[i].control_id, findings[i].relationship
    FROM (SELECT line_no, clause_id, findings, unnest(range(1, len(findings) + 1)) AS i FROM findings_sample) WHERE findings[i] IS NOT NULL)
SELECT src_table, line_no, record_no::INT AS record_no, finding_no::INT AS finding_no, round_no::INT AS round_no, clause_id, coalesce(control_id, '') AS control_id, coalesce(relationship, '') AS relationship FROM flat
"""


P3_UNREAD_SQL = r"""
WITH raw AS (SELECT line_no, payload, regexp_replace(payload, '^\s*```(json)?\s*|\s*```\s*$', '', 'g') AS t FROM findings_raw)
SELECT 'findings_raw' AS src_table, line_no, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN NOT regexp_matches(payload, '[\[{]') THEN 'no JSON' ELSE 'cut off' END AS reason
FROM raw WHERE NOT coalesce(json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t ELSE '0' END) IN ('OBJECT', 'ARRAY'), false)
"""
# A list of findings that is spelt in a string is opened, so its nodes count, too.
P3_NODES_SQL = (
    P3_SQL[: P3_SQL.index("opened AS (")].strip().rstrip(",")
    + r""",
t AS (SELECT line_no, k.type AS type FROM doc, json_tree(j) k
  UNION ALL SELECT line_no, k.type FROM (SELECT line_no, CASE WHEN json_type(f) = 'VARCHAR' AND json_valid(f ->> '$') THEN CAST(f ->> '$' AS JSON) END AS o FROM held), json_tree(o) k WHERE o IS NOT NULL AND json_type(o) IN ('ARRAY', 'OBJECT')
  UNION ALL SELECT line_no, k.type FROM (SELECT line_no, CASE WHEN json_type(f, '$.debate') = 'VARCHAR' AND json_valid(f ->> '$.debate') THEN CAST(f ->> '$.debate' AS JSON) END AS o FROM (SELECT line_no, unnest(CASE WHEN json_type(f) = 'ARRAY' THEN CAST(f AS JSON[]) WHEN json_type(f) = 'OBJECT' THEN [f] ELSE [] END) AS f FROM held)), json_tree(o) k WHERE o IS NOT NULL)
SELECT 'findings_raw' AS src_table, line_no, count(*) FILTER (type = 'OBJECT') AS n_objects, count(*) FILTER (type = 'ARRAY') AS n_arrays FROM t GROUP BY 2 HAVING count(*) FILTER (type IN ('OBJECT', 'ARRAY')) > 0
UNION ALL SELECT 'findings_sample', line_no, 1 + coalesce(len(list_filter(findings, lambda f: f IS NOT NULL)), 0), CASE WHEN findings IS NULL THEN 0 ELSE 1 END + coalesce(len(list_filter(findings, lambda f: f.gate_errors IS NOT NULL)), 0) FROM findings_sample
"""
)


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_objects": p3_objects, "p3_bridge": p3_bridge, "p3_nodes": p3_nodes, "p3_unread": p3_unread}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_report": P2_REPORT_SQL, "p3_found": P3_SQL, "p3_nodes": P3_NODES_SQL, "p3_unread": P3_UNREAD_SQL}
