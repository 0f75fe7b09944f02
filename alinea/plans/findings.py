"""Queries over findings, their evidence, rulings and reviews."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alinea.functions.keys import norm_key
from alinea.functions.text import MIN_EVIDENCE, TYPOGRAPHIC, wilson
from alinea.operators import evidence
from alinea.operators.evidence import RELATIONS, judgments, relation
from alinea.operators.nested import shred
from alinea.plans.problems import P3_SQL, p3_found
from alinea.plans.retrieval import _CLA, _CTL, _clause_tree, active_clauses, active_controls
from alinea.operators.hierarchy import path_order, roll_up
from alinea.plans.skew import skew_join
from alinea.plans.stage import staged
from alinea.plans.unions import union_all
from alinea.sources.tables import table

ACCEPT, THRESHOLDS = 0.60, (0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return judgments(table(spark, d, "findings_sample"))


def _haystacks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts that evidence must stand in: a clause's text and its rolled-up text, a control's statement and guidance."""
    clauses, closure = _clause_tree(spark, d)
    full = roll_up(clauses, closure, "clause_id", "text", path_order("path"))
    focal = clauses.join(full, "clause_id").select(norm_key("clause_id").alias("key"), F.concat_ws(" ", "text", "full_text").alias("text"))
    target = active_controls(spark, d, "statement", "guidance").select(norm_key("control_id").alias("key"), F.concat_ws(" ", "statement", "guidance").alias("text"))
    return focal, target


def gate(spark: SparkSession, d: str, nfkc: bool = True) -> DataFrame:
    """Every finding with what is wrong with it and its grade."""
    v = evidence.verify(_rows(spark, d), *_haystacks(spark, d), nfkc=nfkc)
    return v.select("line_no", "finding_no", F.array_join("errors", "|").alias("errors"), evidence.grade(F.col("errors"), F.col("confidence"), ACCEPT).alias("grade"))


def gate_verify(spark: SparkSession, d: str) -> DataFrame:
    """The gate with full compatibility folding."""
    return gate(spark, d)


def gate_plain(spark: SparkSession, d: str) -> DataFrame:
    """The gate that folds quotes, dashes and blanks only, which SQL can express too."""
    return gate(spark, d, nfkc=False)


def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason is found, alone and at all, by the plain gate."""
    e = F.split(F.nullif("errors", F.lit("")), r"\|")
    each = gate_plain(spark, d).select(e.alias("e")).select(F.explode("e").alias("reason"), (F.size("e") == 1).alias("alone"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("n_alone"))


def grade_mix(spark: SparkSession, d: str) -> DataFrame:
    """Grades by the plain gate with whole percentages."""
    return evidence.shares(gate_plain(spark, d), ["grade"])


def noted_errors(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier tool noted against findings, by the field before the colon."""
    e = _rows(spark, d).select("line_no", F.explode("gate_errors").alias("e"))
    return e.groupBy(F.split_part("e", F.lit(":"), F.lit(1)).alias("field"), F.trim(F.split_part("e", F.lit(":"), F.lit(2))).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("n_lines"))


def parse_failures(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the kind of parse error (before the colon) and model; the lines to be sent again."""
    f = table(spark, d, "findings_sample").where("coalesce(parse_error, '') <> ''")
    return f.groupBy(F.split_part("parse_error", F.lit(":"), F.lit(1)).alias("kind"), "model").agg(F.count(F.lit(1)).alias("n"))


def relation_mix(spark: SparkSession, d: str) -> DataFrame:
    """Relations by family of the control, pivoted over the reportable ones."""
    r = _rows(spark, d).select(F.split_part(norm_key("control_id"), F.lit("-"), F.lit(1)).alias("family"), relation("relationship").alias("r")).where("family is not null")
    return r.groupBy("family").agg(*[F.count_if(F.col("r") == x).alias(x) for x in RELATIONS], F.count(F.lit(1)).alias("n"))


def judgment_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: lines, lines without findings, findings, distinct clauses and controls, findings with an open parameter."""
    f = table(spark, d, "findings_sample")
    lines = f.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.coalesce(F.size("findings"), F.lit(0)) <= 0).alias("n_without"), F.count_distinct(norm_key("clause_id")).alias("n_clauses"))
    each = _rows(spark, d).agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct(norm_key("control_id")).alias("n_controls"), F.count_if("parameter_gap").alias("n_parameter_gaps"))
    return lines.crossJoin(each)  # one row each


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Findings with at least each threshold's confidence and their whole percentage."""
    c = _rows(spark, d).where("confidence is not null").select("confidence")
    counts = c.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("confidence") >= t).alias(f"n{i}") for i, t in enumerate(THRESHOLDS)])
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(THRESHOLDS)])
    return counts.select("total", F.explode(each).alias("e")).select("e.threshold", "e.n", F.expr("100 * e.n div total").alias("percent"))


def _overlaid(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("line_no", "finding_no", norm_key("clause_id").alias("clause"), norm_key("control_id").alias("control"), relation("relationship").alias("relationship"), "confidence")
    r = table(spark, d, "review").where("label in ('correct', 'wrong', 'wrong_type')")
    rulings = r.select(norm_key("clause_id").alias("clause"), norm_key("control_id").alias("control"), relation("relationship").alias("relationship"), "confidence", "reviewed_at", "review_id")
    return evidence.overlay(rows, rulings.where("clause is not null and control is not null"), ["clause", "control"], ["relationship", "confidence"], ["reviewed_at", "review_id"])


def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Findings with relation and confidence of the last review of the same clause and control, where there is one."""
    return _overlaid(spark, d)


def relation_shift(spark: SparkSession, d: str) -> DataFrame:
    """How reviews move findings from relation to relation."""
    return _overlaid(spark, d).where("ruled").groupBy("original_relationship", "relationship").agg(F.count(F.lit(1)).alias("n"))


def before_after(spark: SparkSession, d: str) -> DataFrame:
    """Per relation: findings before and after reviews, the difference, and mean confidences (null as 0)."""
    o = _overlaid(spark, d)
    pairs = o.select(F.explode(F.array(F.struct(F.col("original_relationship").alias("relationship"), F.col("original_confidence").alias("c"), F.lit(0).alias("after")), F.struct("relationship", F.col("confidence").alias("c"), F.lit(1).alias("after")))).alias("p")).select("p.*").where("relationship is not null")
    b, a = F.col("after") == 0, F.col("after") == 1
    mean = lambda w: F.round(F.avg(F.when(w, F.coalesce("c", F.lit(0.0)))), 6)
    return pairs.groupBy("relationship").agg(F.count_if(b).alias("n_before"), F.count_if(a).alias("n_after"), (F.count_if(a) - F.count_if(b)).alias("delta"), mean(b).alias("confidence_before"), mean(a).alias("confidence_after"))


def debate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Raw judgments with debates: the first relation against that of the last round that rules one."""
    flat = staged(p3_found(spark, d).where("src_table = 'findings_raw'"), "flat")
    keys = ["line_no", "record_no", "finding_no"]
    last = flat.where("round_no > 0").groupBy(*keys).agg(F.max_by("relationship", F.when(F.col("relationship") != "", F.col("round_no"))).alias("last"), F.count(F.lit(1)).alias("n_rounds"))
    met = flat.where("round_no = 0").join(last, keys)
    return met.groupBy("relationship", F.coalesce("last", F.lit("")).alias("ruled")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_rounds").alias("n_rounds"))


#: Fields that a debate's report reads from the distinct objects of raw answers.
DEBATED = ("control_id", "relationship", "confidence", "evidence_sama", "evidence_nist", "objection", "grounds", "ruling")


def _debates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Debated raw judgments with their last ruling, and the grounds of each objection. Values come from the distinct objects through the bridge."""
    raw = table(spark, d, "findings_raw").select(F.lit("findings_raw").alias("src_table"), "line_no", "payload")
    occ = staged(shred(raw, DEBATED, canonical=False), "debates")
    some = F.coalesce(*[F.col(c) for c in DEBATED]).isNotNull()
    objects = staged(occ.where(some).groupBy(F.col("node_hash").alias("hash")).agg(*[F.max(c).alias(c) for c in DEBATED]), "objects")
    keys = ["line_no", "record_no", "finding_no"]
    objections = occ.where("step = 'objection' and kind = 'object'").select("line_no", F.col("parent_occ").alias("occ_no"), F.col("node_hash").alias("hash"))
    rounds = occ.where("role = 'round'").select(*keys, "round_no", "occ_no", F.col("value_hash").alias("hash"))
    ruled = skew_join(rounds, objects.select("hash", "control_id", "relationship", "ruling"), ["hash"], "left")
    against = skew_join(objections, objects.select("hash", (F.col("objection") == "true").alias("objects"), "grounds"), ["hash"], "inner")
    each = staged(ruled.drop("hash").join(against.drop("hash"), ["line_no", "occ_no"], "left"), "rounds")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    last = each.groupBy(*keys).agg(F.bool_or(F.coalesce("objects", F.lit(False))).alias("objected"), F.max_by(F.struct(filled("ruling").alias("ruling"), filled("control_id").alias("to_control"), filled("relationship").alias("to_relationship")), F.when(filled("ruling").isNotNull(), F.col("round_no"))).alias("r"))
    first = skew_join(occ.where("role = 'judgment'").select(*keys, "clause_id", F.col("value_hash").alias("hash")), objects.select("hash", *DEBATED[:5]), ["hash"], "inner").drop("hash")
    return first.join(last, keys).select("*", "r.*").drop("r"), each.where("objects").select(F.coalesce(filled("grounds"), F.lit("(unstated)")).alias("value"))


def debate_report(spark: SparkSession, d: str) -> DataFrame:
    """Debates of raw judgments: how many, objections and changes with whole percentages, verdicts, grounds, statuses after the gate, and what the gate blocked."""
    rows, grounds = _debates(spark, d)
    rows = staged(rows, "debated")
    changed = evidence.changed(F.col("ruling"), [F.col("relationship"), F.col("control_id")], [F.coalesce("to_relationship", "relationship"), F.coalesce("to_control", "control_id")])
    after = rows.select(
        "line_no", "record_no", "finding_no", "ruling", "clause_id", F.array("control_id").alias("offered"), F.coalesce("to_control", "control_id").alias("control_id"), F.coalesce("to_relationship", "relationship").alias("relationship"),
        F.col("confidence").try_cast("double").alias("confidence"), "evidence_sama", "evidence_nist")
    gated = staged(evidence.verify(after, *_haystacks(spark, d), nfkc=False).select("ruling", "errors", evidence.resolve(F.col("ruling"), F.col("errors"), F.col("confidence"), ACCEPT).alias("status")), "gated")
    n = rows.agg(F.count(F.lit(1)).alias("debated"), F.count_if("objected").alias("objected"), F.count_if(changed).alias("changed"))
    totals = n.select(F.explode(F.array(*[F.struct(F.lit(x).alias("section"), F.lit("").alias("value"), F.col(x).alias("n"), F.expr(f"100 * {x} div greatest(debated, 1)").alias("percent")) for x in ("debated", "objected", "changed")])).alias("t")).select("t.*")
    blocked = gated.where("ruling in ('uphold', 'revise')").select(F.explode("errors").alias("value"))
    parts = [("verdict", rows.select(F.coalesce("ruling", F.lit("(none)")).alias("value"))), ("grounds", grounds), ("status", gated.select(F.coalesce("status", F.lit("unresolved")).alias("value"))), ("blocked", blocked)]
    return union_all([totals, *[p.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("section"), "value", "n", F.lit(None).cast("bigint").alias("percent")) for s, p in parts]])


def debate_bands(spark: SparkSession, d: str) -> DataFrame:
    """How many findings each way of selecting them puts up for debate; rejected ones never are."""
    f = _rows(spark, d).select("confidence", "status", relation("relationship").alias("relationship"))
    c, s = F.col("confidence"), F.col("status")
    ways = {"all": evidence.in_band(c, s), "disputed": evidence.in_band(c, s, below=ACCEPT), "provisional": evidence.in_band(c, s, 0.50, 0.70), "intersects": evidence.in_band(c, s) & (F.col("relationship") == "intersects_with")}
    counted = f.agg(*[F.count_if(w).alias(n) for n, w in ways.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("n")) for n in ways])).alias("b")).select("b.*")


def mock_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first three candidates of every clause through the deterministic proposer, the gate, opponent and arbiter, and the gate again."""
    c = table(spark, d, "candidates").where("clause_id is not null and control_id is not null and score is not null and not isnan(score)")
    best = c.groupBy(F.col("clause_id").alias("query"), "control_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "control_id")
    top = best.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    clauses = active_clauses(spark, d, "text").select(F.col("clause_id").alias("key"), "text")
    controls = active_controls(spark, d, "statement").select(F.col("control_id").alias("key"), F.col("statement").alias("text"))
    made = evidence.mock_proposals(top, clauses, controls)
    rows = made.withColumnRenamed("query", "clause_id").withColumn("offered", F.array("control_id"))
    focal, target = (x.withColumn("key", norm_key("key")) for x in (clauses, controls))
    first = evidence.verify(rows, focal, target, nfkc=False)
    ruled = evidence.mock_debate(first).withColumn("before", evidence.grade(F.col("errors"), F.col("confidence"), ACCEPT)).withColumn("after", evidence.grade(F.col("errors"), F.col("new_confidence"), ACCEPT))
    return ruled.groupBy("rank", "relationship", "new_relationship", "ruling", "before", "after").agg(F.count(F.lit(1)).alias("n"))


#: Confidence bands, the highest first: from which confidence on.
BANDS = [("confirmed", 0.70), ("provisional", 0.55)]


def band_of(confidence: Column) -> Column:
    """The band of a confidence; null counts as 0."""
    out = F.lit("weak")
    for name, low in BANDS[::-1]:
        out = F.when(F.coalesce(confidence, F.lit(0.0)) >= low, name).otherwise(out)
    return F.when(F.coalesce(confidence, F.lit(0.0)) < 1.01, out).otherwise("weak")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed items with a label, each as it was sent last."""
    r = table(spark, d, "review").where("review_id is not null").groupBy("review_id").agg(F.max_by(F.struct("confidence", "label", "relationship"), F.struct("received_at", "reviewed_at", "label")).alias("r")).select("review_id", "r.*")
    return r.where("label <> ''").select("label", band_of(F.col("confidence")).alias("band"), relation("relationship").alias("relationship"))


def precision_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision of reviewed items overall, by confidence band and by relation, with Wilson bounds; undecided labels don't count."""
    r = _labelled(spark, d).where("label <> 'unsure'")
    scopes = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("").alias("value")), F.struct(F.lit("band").alias("scope"), F.col("band").alias("value")), F.struct(F.lit("relationship").alias("scope"), F.col("relationship").alias("value")))
    g = r.select("label", F.explode(scopes).alias("s")).groupBy("s.scope", "s.value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "correct").alias("hits"))
    return g.select("scope", "value", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(wilson(F.col("hits"), F.col("n"), False), 6).alias("low"), F.round(wilson(F.col("hits"), F.col("n"), True), 6).alias("high"))


def label_mix(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed items by label."""
    return _labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of about 60 findings in proportion to their confidence bands (a sampling operator)."""
    band = F.when(F.col("confidence") >= 0.70, "high").when(F.col("confidence") >= 0.55, "middle").when(F.col("confidence").isNotNull(), "low")
    rows = _rows(spark, d).withColumn("key", F.concat_ws("/", "line_no", "finding_no")).select("key", "line_no", "finding_no", "confidence", band.alias("band"))
    return evidence.spread_sample(rows, F.col("band"), "key", 60).select("line_no", "finding_no", "band")


def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many of each band the sample has."""
    return review_sample(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def lines_to_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Clauses whose lines all failed to parse, or that have no line: what a resumed run has still to do."""
    from alinea.streaming.resume import still_to_do

    done = table(spark, d, "findings_sample").select("clause_id", F.col("parse_error").alias("error"))
    return still_to_do(active_clauses(spark, d, "clause_id").select("clause_id"), done, "clause_id")


#: Candidates of a clause that a prompt shows.
SHOWN = 10


def prompt_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of a clause with its best candidates: their number and estimated tokens by framework.

    Candidates are cut to the best ``SHOWN`` of each clause before their texts come to them: by a window that Spark
    limits in every partition before the shuffle.
    """
    best = table(spark, d, "candidates").where("clause_id is not null and control_id is not null and score is not null and not isnan(score)").groupBy("clause_id", "control_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("clause_id").orderBy(F.desc("score"), "control_id")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SHOWN)
    controls = active_controls(spark, d, "title", "statement").select("control_id", "title", "statement")
    per = top.join(controls, "control_id").groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct("control_id", "title", "statement"))).alias("candidates"))
    rows = active_clauses(spark, d, "framework", "text").select("clause_id", "framework", "text").join(per, "clause_id")
    made = evidence.prompts(rows, {"clause_id": "Clause", "text": "Text"})
    return made.groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.sum(evidence.estimated_tokens("prompt")).alias("n_tokens"), F.max(F.length("prompt")).alias("longest"))


def debate_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of opponents and arbiters over all findings of known clauses: their number and lengths by relation."""
    k = active_controls(spark, d, "title", "family", "family_title", "is_enhancement", "parent_id", "statement", "params")
    control = k.select(norm_key("control_id").alias("key"), F.struct("control_id", "title", "family", "family_title", "is_enhancement", "parent_id", "statement", "params").alias("control"))
    c = active_clauses(spark, d, "subdomain", "subdomain_title", "text", "numeric_params")
    clause = c.select(norm_key("clause_id").alias("clause_key"), F.struct("clause_id", "subdomain", "subdomain_title", F.lit("").alias("principle"), "text", F.lit(0).alias("n_children"), F.lit("").alias("full_text"), "numeric_params").alias("clause"))
    rows = _rows(spark, d).select("line_no", "finding_no", norm_key("clause_id").alias("clause_key"), norm_key("control_id").alias("key"), "offered", F.struct(norm_key("control_id").alias("control_id"), relation("relationship").alias("relationship"), "confidence", "evidence_sama", "evidence_nist", "rationale").alias("finding"))
    each = rows.select("line_no", "finding_no", F.posexplode("offered").alias("at", "o")).select("line_no", "finding_no", "at", norm_key("o").alias("key"))
    # A line's offer is bounded by what one prompt shows.
    others = skew_join(each, control, ["key"], "inner").groupBy("line_no", "finding_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "control"))), lambda x: x["control"]).alias("others"))
    met = skew_join(skew_join(rows, clause, ["clause_key"], "inner"), control, ["key"], "left").drop("offered").join(others, ["line_no", "finding_no"], "left")
    met = met.withColumn("others", F.coalesce("others", F.array().cast(dict(others.dtypes)["others"])))
    objects = F.coalesce(F.col("finding.relationship") == "intersects_with", F.lit(False))
    objection = F.struct(objects.alias("objection"), F.lit("wrong_type").alias("grounds"), F.lit("The control is broader.").alias("argument"), F.when(objects, "subset_of").otherwise("").alias("proposed_relationship"), F.when(objects, F.get("others", F.lit(0))["control_id"]).alias("proposed_control_id"), F.lit(0.7).alias("strength"))
    opponent, arbiter = evidence.opponent_prompt(F.col("clause"), F.col("finding"), F.col("control"), F.col("others")), evidence.arbiter_prompt(F.col("clause"), F.col("finding"), objection, F.col("control"), F.col("others"))
    out = met.select(F.col("finding.relationship").alias("relationship"), F.length(opponent).alias("a"), F.length(arbiter).alias("b"))
    return out.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("opponent_chars"), F.max("a").alias("opponent_longest"), F.sum("b").alias("arbiter_chars"), F.max("b").alias("arbiter_longest"))


_J = """j AS (SELECT line_no, i AS finding_no, clause_id, offered, findings[i] AS f FROM (SELECT line_no, clause_id, offered, findings, unnest(range(1, len(findings) + 1))::INT AS i FROM findings_sample) WHERE findings[i] IS NOT NULL)"""
_REL = r"regexp_replace(lower(trim({})), '\s+', '_', 'g')"


def _norm(x: str) -> str:
    a, b = "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()).replace("'", "''")
    return rf"lower(trim(regexp_replace(translate(coalesce({x}, ''), '{a}', '{b}'), '\s+', ' ', 'g')))"


_GATE = f"""WITH RECURSIVE {_CLA}, {_CTL}, {_J},
anc AS (SELECT c.clause_id AS node, p.clause_id AS ancestor, p.parent_id AS up FROM cla c JOIN cla p ON c.parent_id = p.clause_id UNION ALL SELECT a.node, p.clause_id, p.parent_id FROM anc a JOIN cla p ON a.up = p.clause_id),
b AS (SELECT node, ancestor FROM anc UNION ALL SELECT clause_id, clause_id FROM cla),
full_ AS (SELECT ancestor AS clause_id, string_agg(text, ' ' ORDER BY list_aggregate(list_transform(string_split(path, '.'), lambda m: CASE WHEN regexp_full_match(m, '[0-9]+') THEN lpad(m, 6, '0') ELSE m END), 'string_agg', '.'), clause_id) AS full_text FROM b JOIN cla ON clause_id = node GROUP BY 1),
hf AS (SELECT upper(trim(c.clause_id)) AS k, {_norm("c.text || ' ' || full_text")} AS h FROM cla c JOIN full_ ON full_.clause_id = c.clause_id),
ht AS (SELECT upper(trim(control_id)) AS k, {_norm("concat_ws(' ', statement, guidance)")} AS h FROM ctl),
e AS (SELECT j.*, {_norm("f.evidence_sama")} AS ef, {_norm("f.evidence_nist")} AS et, coalesce(hf.h, '') AS xf, coalesce(ht.h, '') AS xt,
  upper(trim(f.control_id)) AS ck FROM j LEFT JOIN hf ON hf.k = upper(trim(j.clause_id)) LEFT JOIN ht ON ht.k = upper(trim(f.control_id)))
, g AS (SELECT line_no, finding_no, f.confidence AS confidence, array_to_string(list_filter([
  CASE WHEN ck IS NULL OR ck = '' OR NOT coalesce(list_contains(list_transform(offered, lambda o: upper(trim(o))), ck), false) THEN 'not_offered' END,
  CASE WHEN NOT coalesce({_REL.format('f.relationship')} IN ('equal', 'subset_of', 'superset_of', 'intersects_with'), false) THEN 'no_reportable_relation' END,
  CASE WHEN NOT coalesce(f.confidence BETWEEN 0 AND 1, false) THEN 'bad_confidence' END,
  CASE WHEN length(ef) < {MIN_EVIDENCE} THEN 'focal_too_short' WHEN NOT contains(xf, ef) THEN 'focal_not_verbatim' END,
  CASE WHEN length(et) < {MIN_EVIDENCE} THEN 'target_too_short' WHEN NOT contains(xt, et) THEN 'target_not_verbatim' END], lambda x: x IS NOT NULL), '|') AS errors FROM e),
gate AS (SELECT line_no, finding_no, errors, CASE WHEN errors <> '' THEN 'rejected' WHEN confidence >= {ACCEPT} THEN 'accepted' ELSE 'disputed' END AS grade FROM g)
"""
_OVER = f"""WITH {_J}, r AS (SELECT upper(trim(clause_id)) AS clause, upper(trim(control_id)) AS control, {_REL.format('relationship')} AS relationship, confidence FROM review
  WHERE label IN ('correct', 'wrong', 'wrong_type') AND trim(clause_id) <> '' AND trim(control_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY upper(trim(clause_id)), upper(trim(control_id)) ORDER BY reviewed_at DESC, review_id DESC) = 1),
o AS (SELECT line_no, finding_no, nullif(upper(trim(j.clause_id)), '') AS clause, nullif(upper(trim(f.control_id)), '') AS control, {_REL.format('f.relationship')} AS original_relationship, f.confidence AS original_confidence,
  coalesce(r.relationship, {_REL.format('f.relationship')}) AS relationship, coalesce(r.confidence, f.confidence) AS confidence, r.clause IS NOT NULL AS ruled
  FROM j LEFT JOIN r ON r.clause = upper(trim(j.clause_id)) AND r.control = upper(trim(f.control_id)))
"""
_ROUNDS = P3_SQL[: P3_SQL.index("rounds AS (")].strip().rstrip(",") + ", rr AS (SELECT * FROM (SELECT *, l[round_no] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS round_no FROM debated)) WHERE json_type(x) = 'OBJECT')"
_LABELLED = rf"""WITH r AS (SELECT label, CASE WHEN coalesce(confidence, 0) >= 1.01 THEN 'weak' WHEN confidence >= 0.70 THEN 'confirmed' WHEN confidence >= 0.55 THEN 'provisional' ELSE 'weak' END AS band, {_REL.format('relationship')} AS relationship
  FROM (SELECT * FROM review WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY received_at DESC, reviewed_at DESC, label DESC) = 1) WHERE label <> '')"""
_WORDS = r"array_to_string(list_slice(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '), 1, 14), ' ')"
_BAND = "CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.55 THEN 'middle' WHEN confidence IS NOT NULL THEN 'low' ELSE 'none' END"


def queries() -> dict:
    names = "gate_verify gate_plain gate_reasons grade_mix noted_errors parse_failures relation_mix judgment_report risk_coverage review_overlay relation_shift before_after debate_outcomes debate_report debate_bands mock_gate precision_report label_mix review_sample sample_sizes lines_to_repeat prompt_sizes debate_prompts"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    z = "1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)"
    centre = "(hits / n + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n)"
    rel = ", ".join(f"count(*) FILTER (r = '{x}') AS {x}" for x in RELATIONS)
    cuts = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (c >= {t}) AS n, (100 * count(*) FILTER (c >= {t}) // count(*))::BIGINT AS percent FROM c" for t in THRESHOLDS)
    return {
        "gate_plain": f"{_GATE} SELECT * FROM gate",
        "gate_reasons": f"{_GATE} SELECT reason, count(*) AS n, count(*) FILTER (k = 1) AS n_alone FROM (SELECT unnest(string_split(errors, '|')) AS reason, len(string_split(errors, '|')) AS k FROM gate WHERE errors <> '') GROUP BY 1",
        "grade_mix": f"{_GATE} SELECT grade, count(*) AS n, (100 * count(*) // (SELECT count(*) FROM gate))::BIGINT AS percent FROM gate GROUP BY 1",
        "noted_errors": f"WITH {_J} SELECT split_part(e, ':', 1) AS field, trim(split_part(e, ':', 2)) AS reason, count(*) AS n, count(DISTINCT line_no) AS n_lines FROM (SELECT line_no, unnest(f.gate_errors) AS e FROM j) GROUP BY 1, 2",
        "parse_failures": "SELECT split_part(parse_error, ':', 1) AS kind, model, count(*) AS n FROM findings_sample WHERE coalesce(parse_error, '') <> '' GROUP BY 1, 2",
        "relation_mix": f"WITH {_J} SELECT family, {rel}, count(*) AS n FROM (SELECT split_part(nullif(upper(trim(f.control_id)), ''), '-', 1) AS family, {_REL.format('f.relationship')} AS r FROM j) WHERE family IS NOT NULL GROUP BY 1",
        "judgment_report": f"WITH {_J} SELECT * FROM (SELECT count(*) AS n_lines, count(*) FILTER (coalesce(len(findings), 0) = 0) AS n_without, count(DISTINCT nullif(upper(trim(clause_id)), '')) AS n_clauses FROM findings_sample), (SELECT count(*) AS n_findings, count(DISTINCT nullif(upper(trim(f.control_id)), '')) AS n_controls, count(*) FILTER (f.parameter_gap) AS n_parameter_gaps FROM j)",
        "risk_coverage": f"WITH {_J}, c AS (SELECT f.confidence AS c FROM j WHERE f.confidence IS NOT NULL) {cuts}",
        "review_overlay": f"{_OVER} SELECT * FROM o",
        "relation_shift": f"{_OVER} SELECT original_relationship, relationship, count(*) AS n FROM o WHERE ruled GROUP BY 1, 2",
        "before_after": f"""{_OVER}, p AS (SELECT original_relationship AS relationship, original_confidence AS c, 0 AS after FROM o UNION ALL SELECT relationship, confidence, 1 FROM o)
SELECT relationship, count(*) FILTER (after = 0) AS n_before, count(*) FILTER (after = 1) AS n_after, count(*) FILTER (after = 1) - count(*) FILTER (after = 0) AS delta,
  round(avg(coalesce(c, 0)) FILTER (after = 0), 6) AS confidence_before, round(avg(coalesce(c, 0)) FILTER (after = 1), 6) AS confidence_after FROM p WHERE relationship IS NOT NULL GROUP BY 1""",
        "mock_gate": f"""WITH {_CLA}, {_CTL}, t AS (SELECT clause_id, control_id, row_number() OVER (PARTITION BY clause_id ORDER BY max(score) DESC, control_id) AS rank FROM candidates
  WHERE clause_id IS NOT NULL AND control_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2 QUALIFY rank <= 3),
p AS (SELECT t.rank, ['subset_of', 'intersects_with', 'equal'][t.rank] AS relationship, [0.82, 0.55, 0.71][t.rank]::DOUBLE AS confidence, {_norm(_WORDS.format('c.text'))} AS ef,
  {_norm(f"CASE WHEN t.rank = 3 THEN 'a span that stands in none of the texts at all' ELSE {_WORDS.format('k.statement')} END")} AS et, {_norm('c.text')} AS xf, {_norm('k.statement')} AS xt
  FROM t JOIN cla c ON c.clause_id = t.clause_id JOIN ctl k ON k.control_id = t.control_id WHERE k.statement <> ''),
g AS (SELECT *, length(ef) < {MIN_EVIDENCE} OR NOT contains(xf, ef) OR length(et) < {MIN_EVIDENCE} OR NOT contains(xt, et) AS bad, CASE WHEN relationship = 'intersects_with' THEN 0.72 ELSE least(1.0, round(confidence + 0.1, 6)) END AS nc FROM p)
SELECT rank, relationship, CASE WHEN relationship = 'intersects_with' THEN 'subset_of' ELSE relationship END AS new_relationship, CASE WHEN relationship = 'intersects_with' THEN 'revise' ELSE 'uphold' END AS ruling,
  CASE WHEN bad THEN 'rejected' WHEN confidence >= {ACCEPT} THEN 'accepted' ELSE 'disputed' END AS before, CASE WHEN bad THEN 'rejected' WHEN nc >= {ACCEPT} THEN 'accepted' ELSE 'disputed' END AS after, count(*) AS n FROM g GROUP BY ALL""",
        "debate_bands": f"""WITH {_J}, x AS (SELECT coalesce(f.confidence, 0) AS c, {_REL.format('f.relationship')} AS r FROM j WHERE coalesce(f.status, '') <> 'rejected')
SELECT 'all' AS band, count(*) AS n FROM x UNION ALL SELECT 'disputed', count(*) FILTER (c < 0.60) FROM x UNION ALL SELECT 'provisional', count(*) FILTER (c >= 0.50 AND c < 0.70) FROM x UNION ALL SELECT 'intersects', count(*) FILTER (r = 'intersects_with') FROM x""",
        "debate_outcomes": f"""{_ROUNDS}, l AS (SELECT line_no, record_no, finding_no, count(*) AS nr, arg_max(x ->> '$.ruling.relationship', CASE WHEN coalesce(x ->> '$.ruling.relationship', '') <> '' THEN round_no END) AS last FROM rr GROUP BY 1, 2, 3)
SELECT coalesce(f ->> '$.relationship', '') AS relationship, coalesce(last, '') AS ruled, count(*) AS n, sum(nr)::BIGINT AS n_rounds FROM judged JOIN l USING (line_no, record_no, finding_no) GROUP BY 1, 2""",
        "debate_report": f"""{_ROUNDS.replace('WITH raw', _GATE.split(', g AS')[0] + ', raw')}, q AS (SELECT line_no, record_no, finding_no, bool_or(coalesce(x ->> '$.objection.objection', '') = 'true') AS objected,
  arg_max(struct_pack(r := x ->> '$.ruling.ruling', c := nullif(x ->> '$.ruling.control_id', ''), rel := nullif(x ->> '$.ruling.relationship', '')), CASE WHEN coalesce(x ->> '$.ruling.ruling', '') <> '' THEN round_no END) AS l FROM rr GROUP BY 1, 2, 3),
bb AS (SELECT q.*, q.l.r AS ruling, clause_id, coalesce(f ->> '$.control_id', '') AS c0, coalesce(f ->> '$.relationship', '') AS r0, coalesce(l.c, f ->> '$.control_id', '') AS c1, coalesce(l.rel, f ->> '$.relationship', '') AS r1, TRY_CAST(f ->> '$.confidence' AS DOUBLE) AS conf,
  {_norm("f ->> '$.evidence_sama'")} AS ef, {_norm("f ->> '$.evidence_nist'")} AS et FROM judged JOIN q USING (line_no, record_no, finding_no)),
v AS (SELECT bb.*, list_filter([CASE WHEN trim(c1) = '' OR upper(trim(c1)) <> upper(trim(c0)) THEN 'not_offered' END, CASE WHEN NOT coalesce({_REL.format('r1')} IN ('equal', 'subset_of', 'superset_of', 'intersects_with'), false) THEN 'no_reportable_relation' END,
  CASE WHEN NOT coalesce(conf BETWEEN 0 AND 1, false) THEN 'bad_confidence' END, CASE WHEN length(ef) < {MIN_EVIDENCE} THEN 'focal_too_short' WHEN NOT contains(coalesce(hf.h, ''), ef) THEN 'focal_not_verbatim' END,
  CASE WHEN length(et) < {MIN_EVIDENCE} THEN 'target_too_short' WHEN NOT contains(coalesce(ht.h, ''), et) THEN 'target_not_verbatim' END], lambda x: x IS NOT NULL) AS errs FROM bb LEFT JOIN hf ON hf.k = upper(trim(clause_id)) LEFT JOIN ht ON ht.k = upper(trim(c1))),
t AS (SELECT count(*) AS debated, count(*) FILTER (objected) AS objected, count(*) FILTER (ruling = 'revise' AND (r0 <> r1 OR c0 <> c1)) AS changed FROM v)
SELECT 'debated' AS section, '' AS value, debated AS n, (100 * debated // greatest(debated, 1))::BIGINT AS percent FROM t UNION ALL SELECT 'objected', '', objected, (100 * objected // greatest(debated, 1))::BIGINT FROM t UNION ALL SELECT 'changed', '', changed, (100 * changed // greatest(debated, 1))::BIGINT FROM t
UNION ALL SELECT 'verdict', coalesce(ruling, '(none)'), count(*), NULL FROM v GROUP BY 2
UNION ALL SELECT 'grounds', coalesce(nullif(x ->> '$.objection.grounds', ''), '(unstated)'), count(*), NULL FROM rr WHERE x ->> '$.objection.objection' = 'true' GROUP BY 2
UNION ALL SELECT 'status', CASE WHEN ruling IN ('uphold', 'revise') THEN CASE WHEN len(errs) > 0 THEN 'rejected' WHEN conf >= {ACCEPT} THEN 'accepted' ELSE 'disputed' END WHEN ruling = 'reject' THEN 'rejected_by_debate' ELSE 'unresolved' END, count(*), NULL FROM v GROUP BY 2
UNION ALL SELECT 'blocked', e, count(*), NULL FROM (SELECT unnest(errs) AS e FROM v WHERE ruling IN ('uphold', 'revise')) GROUP BY 2""",
        "precision_report": f"""{_LABELLED}, s AS (SELECT label, 'overall' AS scope, '' AS value FROM r WHERE label <> 'unsure' UNION ALL SELECT label, 'band', band FROM r WHERE label <> 'unsure' UNION ALL SELECT label, 'relationship', relationship FROM r WHERE label <> 'unsure'),
g AS (SELECT scope, value, count(*) AS n, count(*) FILTER (label = 'correct') AS hits FROM s GROUP BY 1, 2)
SELECT scope, value, n, hits, round(hits / n, 6) AS precision, round(greatest(0, {centre} - {z}), 6) AS low, round(least(1, {centre} + {z}), 6) AS high FROM g""",
        "label_mix": f"{_LABELLED} SELECT label, count(*) AS n FROM r GROUP BY 1",
        "debate_prompts": rf"""WITH {_CLA}, {_CTL}, {_J},
k AS (SELECT upper(trim(control_id)) AS key, control_id, title, statement, '### ' || control_id || ' - ' || coalesce(title, '') || chr(10) || 'Family: ' || coalesce(family, '') || ' (' || coalesce(family_title, '') || ')' || CASE WHEN is_enhancement THEN chr(10) || 'Enhancement of ' || coalesce(parent_id, '') ELSE '' END
  || chr(10) || 'Statement: ' || coalesce(nullif(statement, ''), '(none)') || CASE WHEN len(params) > 0 THEN chr(10) || 'Open parameters: ' || array_to_string(params, '; ') ELSE '' END AS block FROM ctl),
c AS (SELECT upper(trim(clause_id)) AS ck, '## Clause' || chr(10) || 'Identifier: ' || clause_id || chr(10) || 'Subdomain: ' || coalesce(subdomain, '') || ' ' || coalesce(subdomain_title, '') || chr(10) || chr(10) || 'Text:' || chr(10) || coalesce(text, '') || CASE WHEN len(numeric_params) > 0 THEN chr(10) || chr(10) || 'States a value: ' || array_to_string(numeric_params, ', ') ELSE '' END AS block FROM cla),
f AS (SELECT line_no, finding_no, upper(trim(clause_id)) AS ck, nullif(upper(trim(f.control_id)), '') AS key, {_REL.format('f.relationship')} AS rel, CASE WHEN f.confidence IS NULL THEN '' ELSE f.confidence::VARCHAR END AS conf, coalesce(f.evidence_sama, '') AS ea, coalesce(f.evidence_nist, '') AS eb, coalesce(f.rationale, '') AS why FROM j),
o AS (SELECT x.line_no, x.finding_no, x.pl, k.* FROM (SELECT line_no, finding_no, offered[pl] AS o, pl FROM (SELECT line_no, finding_no, offered, unnest(range(1, len(offered) + 1)) AS pl FROM j)) x JOIN k ON k.key = upper(trim(x.o))),
p0 AS (SELECT line_no, finding_no, arg_min(control_id, pl) AS first FROM o GROUP BY 1, 2),
ob AS (SELECT o.*, row_number() OVER (PARTITION BY o.line_no, o.finding_no ORDER BY pl) AS r FROM o JOIN f USING (line_no, finding_no) WHERE o.control_id <> f.key),
oo AS (SELECT line_no, finding_no, string_agg('- ' || control_id || ' - ' || coalesce(title, '') || ': ' || substr(coalesce(statement, ''), 1, 220), chr(10) ORDER BY pl) AS brief FROM ob WHERE r <= 6 GROUP BY 1, 2),
z AS (SELECT f.*, c.block AS cb, k.block AS kb, brief, CASE WHEN rel = 'intersects_with' THEN first END AS instead FROM f JOIN c ON c.ck = f.ck LEFT JOIN k ON k.key = f.key LEFT JOIN oo USING (line_no, finding_no) LEFT JOIN p0 USING (line_no, finding_no)),
pr AS (SELECT o.line_no, o.finding_no, o.pl, o.block FROM o JOIN z USING (line_no, finding_no) WHERE o.control_id = z.instead AND o.control_id <> z.key),
re AS (SELECT o.line_no, o.finding_no, o.pl, o.block, row_number() OVER (PARTITION BY o.line_no, o.finding_no ORDER BY o.pl) AS r FROM o JOIN z USING (line_no, finding_no) WHERE o.control_id <> z.key AND o.control_id IS DISTINCT FROM z.instead),
ci AS (SELECT line_no, finding_no, string_agg(block || chr(10), chr(10) ORDER BY w, pl) AS cited FROM (SELECT line_no, finding_no, 0 AS w, 0 AS pl, kb AS block FROM z WHERE kb IS NOT NULL UNION ALL SELECT line_no, finding_no, 1, pl, block FROM pr UNION ALL SELECT line_no, finding_no, 2, pl, block FROM re WHERE r <= 5) GROUP BY 1, 2),
t AS (SELECT rel, length(cb || chr(10) || chr(10) || '## The proposed mapping' || chr(10) || 'Control: ' || coalesce(key, '') || chr(10) || 'Relationship: ' || coalesce(rel, '') || chr(10) || 'Confidence: ' || chr(10) || 'Evidence from the clause: “' || ea || '”' || chr(10) || 'Evidence from the control: “' || eb || '”' || chr(10) || 'Stated reason: ' || why
   || chr(10) || chr(10) || '## The control as proposed' || coalesce(chr(10) || kb, '') || coalesce(chr(10) || chr(10) || '## Other controls that were available' || chr(10) || brief, '') || chr(10) || chr(10) || 'Return the JSON object now.') AS a, conf,
  length(cb || chr(10) || chr(10) || '## Position A: the proposal' || chr(10) || 'Control: ' || coalesce(key, '') || ', relationship: ' || coalesce(rel, '') || chr(10) || 'Evidence of the clause: “' || ea || '”' || chr(10) || 'Evidence of the control: “' || eb || '”' || chr(10) || 'Reason: ' || why || chr(10) || chr(10) || '## Position B: the objection' || chr(10)
   || CASE WHEN rel = 'intersects_with' THEN 'Grounds: wrong_type' || chr(10) || 'Argument: The control is broader.' || chr(10) || 'Proposed instead: subset_of' || coalesce(' on ' || instead, '') || chr(10) || 'Stated strength: 0.7' ELSE 'No objection raised. Reason given: The control is broader.' END
   || chr(10) || chr(10) || '## Candidate controls (only these may be cited)' || chr(10) || coalesce(cited, '') || chr(10) || 'Return the JSON object now.') AS b FROM z LEFT JOIN ci USING (line_no, finding_no))
SELECT rel AS relationship, count(*) AS n, sum(a + length(conf))::BIGINT AS opponent_chars, max(a + length(conf)) AS opponent_longest, sum(b)::BIGINT AS arbiter_chars, max(b) AS arbiter_longest FROM t GROUP BY 1""",
        "review_sample": f"""WITH {_J}, k AS (SELECT line_no, finding_no, line_no || '/' || finding_no AS key, {_BAND.replace('confidence', 'f.confidence')} AS band FROM j WHERE f.confidence IS NOT NULL),
b AS (SELECT band, greatest(5, round_even(60 * count(*) / (SELECT count(*) FROM k), 0)::BIGINT) AS want FROM k GROUP BY 1)
SELECT line_no, finding_no, band FROM k JOIN b USING (band) QUALIFY row_number() OVER (PARTITION BY band ORDER BY ('0x' || substr(md5('17|' || key), 1, 15))::BIGINT, key) <= want""",
        "sample_sizes": f"WITH {_J}, b AS (SELECT {_BAND.replace('confidence', 'f.confidence')} AS band, count(*) AS n FROM j WHERE f.confidence IS NOT NULL GROUP BY 1) SELECT band, least(n, greatest(5, round_even(60 * n / (SELECT sum(n) FROM b), 0)::BIGINT)) AS n FROM b",
        "lines_to_repeat": f"WITH {_CLA} SELECT clause_id FROM cla WHERE clause_id NOT IN (SELECT clause_id FROM findings_sample WHERE coalesce(parse_error, '') = '' AND clause_id IS NOT NULL)",
        "prompt_sizes": f"""WITH {_CLA}, {_CTL}, c AS (SELECT clause_id, control_id FROM candidates WHERE clause_id IS NOT NULL AND control_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY max(score) DESC, control_id) <= 10),
p AS (SELECT a.clause_id, any_value(framework) AS framework, 'Clause: ' || a.clause_id || chr(10) || 'Text: ' || any_value(a.text) || chr(10) || string_agg('### ' || k.control_id || ' ' || k.title || chr(10) || coalesce(nullif(k.statement, ''), '(no statement)'), chr(10) ORDER BY k.control_id) || chr(10) || 'Return a JSON array.' AS p
  FROM cla a JOIN c ON c.clause_id = a.clause_id JOIN ctl k ON k.control_id = c.control_id GROUP BY 1)
SELECT framework, count(*) AS n, sum(length(p) // 4)::BIGINT AS n_tokens, max(length(p)) AS longest FROM p GROUP BY 1""",
    }
