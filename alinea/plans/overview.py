"""Queries that sum up catalogue, coverage and register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.functions.keys import norm_key
from alinea.functions.text import clip, enumerative, fingerprint, natural_key
from alinea.operators import records
from alinea.operators.evidence import judgments, relation
from alinea.operators.order import places
from alinea.plans.retrieval import _CLA, _CTL, active_clauses, active_controls
from alinea.plans.stage import staged
from alinea.sources.tables import table

KINDS = ["stem", "substantive", "referential"]
#: Parameters of the queries: families whose membership is followed, years that a register should cover, and its schema.
FOLLOWED, YEARS = ["KV", "LM"], (2008, 2026)
SCHEMA = {
    "required": ["doc_id", "text", "lang", "issuing_body"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 1},
        "text": {"type": "string", "minLength": 20},
        "lang": {"type": "string", "enum": ["en", "fr", "de", "es", "ar", "ja"]},
        "source": {"type": "string", "pattern": "[A-Z]{2,4}-[A-Z]{3}-[0-9]{4}-[0-9]{2}$"},
        "title_en": {"type": "string", "minLength": 3},
        "issuing_body": {"type": "string"},
        "status": {"type": "string", "enum": ["binding", "advisory", "draft"]},
        "year": {"type": "integer", "minimum": 2012, "maximum": 2025},
    },
}


def _findings(spark: SparkSession, d: str) -> DataFrame:
    j = judgments(table(spark, d, "findings_sample"))
    return j.select("line_no", "finding_no", norm_key("clause_id").alias("clause"), norm_key("control_id").alias("control"), relation("relationship").alias("relationship"), "confidence", "status", "parameter_gap")


def clause_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Clauses by framework and subdomain, pivoted by kind, with a key that sorts subdomains as numbers."""
    c = active_clauses(spark, d, "framework", "subdomain", "clause_type", "has_numeric_param", "deontic", "level")
    kinds = [F.count_if(F.col("clause_type") == k).alias(k) for k in KINDS]
    g = c.groupBy("framework", "subdomain").agg(*kinds, F.count(F.lit(1)).alias("n"), F.count_if("has_numeric_param").alias("n_with_value"), F.count_if(F.col("deontic").isNotNull()).alias("n_modal"), F.max("level").alias("depth"))
    return g.withColumn("sort_key", F.array_join(F.transform(natural_key("subdomain"), lambda x: F.lpad(x.cast("string"), 4, "0")), "."))


def catalogue_families(spark: SparkSession, d: str) -> DataFrame:
    """Per family: base controls, enhancements, parameters, related links, and withdrawn keys."""
    last = table(spark, d, "controls").groupBy("control_id").agg(F.max_by(F.struct("*"), "loaded_at").alias("r")).select("r.*")
    held = F.col("withdrawn_at").isNull() & ~F.col("withdrawn")
    return last.groupBy("family").agg(
        F.count_if(held & ~F.col("is_enhancement")).alias("n_base"), F.count_if(held & F.col("is_enhancement")).alias("n_enhancements"),
        F.sum(F.when(held, F.col("n_params")).otherwise(0)).alias("n_params"), F.sum(F.when(held, F.size("related")).otherwise(0)).alias("n_related"), F.count_if(~held).alias("n_withdrawn"),
    )


def family_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per family: active controls, those without an accepted finding, those in no shortlist row, with percentages (half to even)."""
    c = active_controls(spark, d, "family").select("family", norm_key("control_id").alias("control"))
    accepted = _findings(spark, d).where("status = 'accepted'").select("control").where("control is not null").distinct().withColumn("_a", F.lit(1))
    reached = table(spark, d, "candidates").select(norm_key("control_id").alias("control")).where("control is not null").distinct().withColumn("_r", F.lit(1))
    g = c.join(accepted, "control", "left").join(reached, "control", "left").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a").isNull()).alias("n_unmatched"), F.count_if(F.col("_r").isNull()).alias("n_unreached"))
    share = lambda x: F.bround(100 * F.col(x) / F.col("n")).cast("int")
    return g.select("*", share("n_unmatched").alias("unmatched_percent"), share("n_unreached").alias("unreached_percent"))


def judged_clauses(spark: SparkSession, d: str) -> DataFrame:
    """``clause`` and the ``findings`` of its last line that could be parsed: what a clause's judgment is."""
    lines = table(spark, d, "findings_sample").where("coalesce(parse_error, '') = ''").select(norm_key("clause_id").alias("clause"), "line_no", "findings").where("clause is not null")
    return lines.groupBy("clause").agg(F.max_by(F.struct("findings"), "line_no").alias("r")).select("clause", F.coalesce("r.findings", F.array().cast(dict(lines.dtypes)["findings"])).alias("findings"))


def mappable(spark: SparkSession, d: str) -> DataFrame:
    """``clause`` with its area and whether it states something to map: ``listed`` items and ``referential`` clauses don't."""
    c = active_clauses(spark, d, "framework", "subdomain", "subdomain_title", "clause_type", "parent_id", "deontic", "text", "has_numeric_param")
    keys = c.select(F.col("clause_id").alias("parent_id"), F.lit(True).alias("_p"))
    met = c.join(keys, "parent_id", "left")
    inherits = F.col("deontic").isNull() & F.col("_p").isNotNull()
    return met.select(norm_key("clause_id").alias("clause"), "framework", "subdomain", "subdomain_title", "text", "has_numeric_param", enumerative(F.col("text"), inherits).alias("listed"), F.coalesce(F.col("clause_type") == "referential", F.lit(False)).alias("referential"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """``clause, control, family``: what reviewers found right, the truth that retrieval and gaps are held against."""
    r = table(spark, d, "review").where("label = 'correct'").select(norm_key("clause_id").alias("clause"), norm_key("control_id").alias("control")).where("clause is not null and control is not null").distinct()
    return r.select("clause", "control", F.split_part("control", F.lit("-"), F.lit(1)).alias("family"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Judged clauses that state something: their area, ``n_findings``, ``accepted``, ``disputed``, ``best`` disputed confidence, and ``tested``.

    A clause without an accepted finding was tested if it has findings, or if its candidates reach a family that the
    anchors of its subdomain name. Families of candidates are made distinct before they meet anything.
    """
    has = lambda v: F.exists("findings", lambda f: F.coalesce(f["status"] == v, F.lit(False)))
    best = F.aggregate(F.filter("findings", lambda f: f["status"] == "disputed"), F.lit(0.0), lambda m, f: F.greatest(m, F.coalesce(f["confidence"], F.lit(0.0))))
    j = judged_clauses(spark, d).select("clause", F.size(F.filter("findings", lambda f: f.isNotNull())).alias("n_findings"), has("accepted").alias("accepted"), has("disputed").alias("disputed"), best.alias("best"))
    c = mappable(spark, d)
    rows = j.join(c, "clause", "left").where("not coalesce(listed, false) and not coalesce(referential, false)").drop("listed", "referential")
    rows = rows.withColumns({x: F.coalesce(x, F.lit("")) for x in ("framework", "subdomain", "subdomain_title")})
    expected = anchors(spark, d).join(c.select("clause", "framework", "subdomain"), "clause").select("framework", "subdomain", "family").distinct()
    reached = table(spark, d, "candidates").select(norm_key("clause_id").alias("clause"), F.split_part(norm_key("control_id"), F.lit("-"), F.lit(1)).alias("family")).where("clause is not null and family is not null").distinct()
    tested = reached.join(c.select("clause", "framework", "subdomain"), "clause").join(expected, ["framework", "subdomain", "family"], "left_semi").select("clause").distinct().withColumn("_t", F.lit(True))
    return rows.join(tested, "clause", "left").withColumn("tested", (F.col("n_findings") > 0) | F.col("_t").isNotNull()).drop("_t")


def clause_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per subdomain: its judged clauses by what they came to (accepted, else for review, else nothing found, else not tested), and what it mostly lacks."""
    s = _states(spark, d)
    a, b = F.col("accepted"), F.col("disputed")
    kinds = {"accepted": a, "review": ~a & b, "nothing": ~a & ~b & F.col("tested"), "untested": ~a & ~b & ~F.col("tested")}
    g = s.groupBy("framework", "subdomain").agg(F.max("subdomain_title").alias("title"), *[F.count_if(w).alias(f"n_{n}") for n, w in kinds.items()], F.count(F.lit(1)).alias("n"))
    kind = (
        F.when(F.col("n_nothing") > F.greatest("n_review", "n_untested"), "evidenced absence").when(F.col("n_untested") > F.col("n_review"), "not tested")
        .when(F.col("n_review") > 0, "below threshold").otherwise("covered")
    )
    return g.select("*", F.bround(100 * F.col("n_nothing") / F.col("n")).cast("int").alias("nothing_percent"), kind.alias("kind"))


def clause_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Judged clauses without an accepted finding, the surest gaps first: how sure, what came closest, in the order of the list."""
    s = _states(spark, d).where("not accepted")
    severity = F.when(F.col("n_findings") > 0, "below threshold").when(F.col("tested"), "evidenced absence").otherwise("not tested")
    rows = staged(s.select("clause", "framework", "subdomain", severity.alias("severity"), "best"), "gaps")
    density = rows.groupBy("framework", "subdomain").agg(F.count_if(F.col("severity") == "evidenced absence").alias("density"))
    rank = F.when(F.col("severity") == "evidenced absence", 0).when(F.col("severity") == "not tested", 1).otherwise(2)
    return places(rows.join(density, ["framework", "subdomain"]), rank, F.desc("density"), F.asc("subdomain"), F.asc("best"), F.asc("clause"))


def family_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per family: active controls without an accepted finding and without any that passed, in the order of how little is reached."""
    c = active_controls(spark, d, "family").select("family", norm_key("control_id").alias("control"))
    m = _findings(spark, d).where("status in ('accepted', 'disputed') and control is not null").groupBy("control").agg(F.bool_or(F.col("status") == "accepted").alias("_a"))
    g = c.join(m, "control", "left").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("_a", F.lit(False))).alias("n_unmatched"), F.count_if(F.col("_a").isNull()).alias("n_unreached"))
    share = lambda x: F.bround(100 * F.col(x) / F.col("n")).cast("int")
    g = g.select("*", share("n_unmatched").alias("unmatched_percent"), share("n_unreached").alias("unreached_percent"))
    return places(g, F.desc("unreached_percent"), F.desc("unmatched_percent"), F.asc("family"))


def clause_order(spark: SparkSession, d: str) -> DataFrame:
    """Judged clauses by framework, subdomain as numbers, and key."""
    c = active_clauses(spark, d, "framework", "subdomain").select(norm_key("clause_id").alias("clause"), "framework", "subdomain")
    rows = judged_clauses(spark, d).select("clause").join(c, "clause")
    return places(rows, F.asc("framework"), natural_key("subdomain").asc(), F.asc("clause"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    """One row: clauses that state something and those left out, findings by status, clauses covered, gaps by kind, findings broader than their control, parameter gaps, and aligned ones."""
    s = staged(_states(spark, d), "states")
    j = staged(judged_clauses(spark, d).join(mappable(spark, d).select("clause", "has_numeric_param", "listed", "referential"), "clause", "left"), "judged")
    f = j.select("clause", "has_numeric_param", F.explode("findings").alias("f")).where("f is not null").select("has_numeric_param", relation("f.relationship").alias("r"), "f.status", "f.parameter_gap")
    acc, ver = F.col("status") == "accepted", F.col("status").isin("accepted", "disputed")
    per = s.agg(
        F.count(F.lit(1)).alias("n_mappable"), F.count_if("accepted").alias("n_covered"), F.count_if(~F.col("accepted") & (F.col("n_findings") == 0) & F.col("tested")).alias("n_absent"),
        F.count_if(~F.col("accepted") & ~F.col("tested")).alias("n_untested"), F.count_if(~F.col("accepted") & (F.col("n_findings") > 0)).alias("n_below"))
    of = f.agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_if(acc).alias("n_accepted"), F.count_if(F.col("status") == "disputed").alias("n_disputed"), F.count_if(ver & (F.col("r") == "superset_of")).alias("n_broader"),
        F.count_if(acc & F.col("parameter_gap") & F.coalesce("has_numeric_param", F.lit(False))).alias("n_hard"), F.count_if(acc & F.col("parameter_gap") & ~F.coalesce("has_numeric_param", F.lit(False))).alias("n_soft"),
        F.count_if(ver & F.col("r").isin("equal", "subset_of")).alias("n_aligned"), F.count_if(ver).alias("n_verified"))
    left = j.agg(F.count_if(F.coalesce("listed", F.lit(False)) | F.coalesce("referential", F.lit(False))).alias("n_left_out"))
    out = per.crossJoin(of).crossJoin(left)  # one row each
    return out.select("*", F.expr("100 * n_covered div greatest(n_mappable, 1)").alias("covered_percent"), (F.col("n_findings") - F.col("n_accepted") - F.col("n_disputed")).alias("n_rejected"))


def overall(spark: SparkSession, d: str) -> DataFrame:
    """One row of sizes: controls, clauses, pairs, shortlist rows, findings and documents."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    out = one(active_controls(spark, d, "control_id"), "n_controls").crossJoin(one(active_clauses(spark, d, "clause_id"), "n_clauses"))  # one row each, as below
    out = out.crossJoin(one(table(spark, d, "candidates"), "n_candidates")).crossJoin(one(_findings(spark, d), "n_findings")).crossJoin(one(table(spark, d, "documents"), "n_documents"))
    return out.withColumn("n_pairs", F.col("n_controls") * F.col("n_clauses"))


def broader_targets(spark: SparkSession, d: str) -> DataFrame:
    """Findings that passed and whose clause is broader than the control, with a short form of the clause."""
    f = _findings(spark, d).where("relationship = 'superset_of' and status in ('accepted', 'disputed')")
    texts = active_clauses(spark, d, "text").select(norm_key("clause_id").alias("clause"), clip("text", 40).alias("short"))
    return f.select("line_no", "finding_no", "clause", "control", "confidence").join(texts, "clause", "left")


def parameter_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Findings with an open parameter by whether their clause states a value: hard and soft gaps."""
    f = _findings(spark, d).where("parameter_gap")
    values = active_clauses(spark, d, "has_numeric_param").select(norm_key("clause_id").alias("clause"), "has_numeric_param")
    met = f.join(values, "clause", "left")
    return met.groupBy(F.when(F.col("has_numeric_param"), "hard").otherwise("soft").alias("kind"), "status").agg(F.count(F.lit(1)).alias("n"))


def followed_families(spark: SparkSession, d: str) -> DataFrame:
    """Controls of the followed families: how many there are, and how many findings and accepted findings match them."""
    c = active_controls(spark, d, "family").where(F.col("family").isin(FOLLOWED)).select("family", norm_key("control_id").alias("control"))
    f = _findings(spark, d).groupBy("control").agg(F.count(F.lit(1)).alias("nf"), F.count_if(F.col("status") == "accepted").alias("na"))
    g = c.join(f, "control", "left").groupBy("family")
    return g.agg(F.count(F.lit(1)).alias("n_controls"), F.count("nf").alias("n_found"), F.count_if(F.col("na") > 0).alias("n_accepted"))


def enumerations(spark: SparkSession, d: str) -> DataFrame:
    """List items that state nothing themselves, per framework, and its clauses."""
    return mappable(spark, d).groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.count_if("listed").alias("n_listed"))


def evidenced_absence(spark: SparkSession, d: str) -> DataFrame:
    """Judged clauses that state something and have no accepted finding: whether the absence was tested, and how many such their subdomain has."""
    s = staged(_states(spark, d).where("not accepted").select("clause", "framework", "subdomain", "tested"), "absent")
    density = s.groupBy("framework", "subdomain").agg(F.count_if("tested").alias("density"))
    return s.join(density, ["framework", "subdomain"])


def best_examples(spark: SparkSession, d: str) -> DataFrame:
    """For each subdomain the clause with an accepted finding that shows most: one with an open parameter, then the most accepted findings, the highest confidence, the last key."""
    c = active_clauses(spark, d, "framework", "subdomain").select(norm_key("clause_id").alias("clause"), "framework", "subdomain")
    f = judged_clauses(spark, d).select("clause", F.explode(F.filter("findings", lambda f: f["status"] == "accepted")).alias("f"))
    per = f.groupBy("clause").agg(F.bool_or(F.coalesce("f.parameter_gap", F.lit(False))).alias("has_gap"), F.count(F.lit(1)).alias("n_accepted"), F.max(F.coalesce("f.confidence", F.lit(0.0))).alias("top"))
    best = per.join(c, "clause").groupBy("framework", "subdomain").agg(F.max(F.struct("has_gap", "n_accepted", "top", "clause")).alias("b"))
    return best.select("framework", "subdomain", "b.clause", "b.has_gap", "b.n_accepted", "b.top")


def best_example(spark: SparkSession, d: str) -> DataFrame:
    """The clause that shows most of all."""
    return best_examples(spark, d).agg(F.max(F.struct("has_gap", "n_accepted", "top", "clause")).alias("b")).select("b.*").where("clause is not null")


def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Documents that break the register's schema, with what is wrong."""
    docs = table(spark, d, "documents").select(*SCHEMA["properties"])
    return docs.select("doc_id", records.problems(SCHEMA, docs.dtypes).alias("p")).where(F.size("p") > 0).select("doc_id", F.array_join("p", "|").alias("problems"))


def record_guard(spark: SparkSession, d: str) -> DataFrame:
    """Per status: documents with a line break in the title, a sentence twice, no language, or a wrong character count."""
    docs = table(spark, d, "documents")
    return docs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("title_en").rlike(r"[\r\n]")).alias("n_broken_titles"), F.count_if(records.repeated_sentences("text")).alias("n_repeating"),
        F.count_if(F.coalesce("lang", F.lit("und")) == "und").alias("n_no_language"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_miscounted"),
    )


def record_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text an earlier document has."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    return records.repeats(docs, "digest", "doc_id").select("doc_id", F.col("first_at").alias("first_doc_id"))


def record_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Documents by status, language, issuer and year."""
    return records.tallies(table(spark, d, "documents"), ["status", "lang", "issuing_body", "year"])


def related_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Families that active controls' related lists name, element by element."""
    c = active_controls(spark, d, "related").select(F.transform("related", lambda x: F.split_part(x, F.lit("-"), F.lit(1))).alias("related_family"))
    return records.tallies(c, ["related_family"])


def issuer_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per issuer the kinds of document in its sources' names, sorted and joined."""
    docs = table(spark, d, "documents").where("issuing_body is not null and source is not null")
    kind = F.split_part("source", F.lit("-"), F.lit(2))
    return docs.groupBy("issuing_body").agg(F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("kinds"), F.count_distinct("source").alias("n_sources"))


def uncovered_years(spark: SparkSession, d: str) -> DataFrame:
    """Years of the wanted span with the binding documents of each; 0 where there is none."""
    years = spark.range(*YEARS).select(F.col("id").cast("int").alias("year"))
    n = table(spark, d, "documents").where("status = 'binding'").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return years.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def hash_drift(spark: SparkSession, d: str) -> DataFrame:
    """An older state of the documents (some missing, some without digest, some other) against what is held."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return records.drift(old, docs.where("doc_id % 13 <> 0"), "doc_id", "digest").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def sniffed_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats of documents' bytes with made-up content types and addresses."""
    docs = table(spark, d, "documents").where("text is not null")
    n = F.col("doc_id")
    content = F.when(n % 17 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).cast("binary")
    kinds = [(3, "text/html; charset=utf-8"), (4, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (5, "application/vnd.ms-excel.Spreadsheet"), (6, "text/plain"), (7, "application/PDF")]
    kind = F.coalesce(*[F.when(n % 11 == k, v) for k, v in kinds])
    ends = ["a.HTM", "a/", "a.docx", "a.xls", "a.pdf", "a.json", "a.html?x=1"]
    address = F.concat(F.lit("https://x.test/"), F.element_at(F.array(*map(F.lit, ends)), (n % 7 + 1).cast("int")))
    return docs.select(records.sniff(content, kind, address).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def _register(spark: SparkSession, d: str) -> DataFrame:
    """A register made of the documents, with faults of every kind."""
    n = F.col("doc_id")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, d, "documents").select(
        F.when(n % 50 == 0, F.lit("XX-DUP-ID-2020")).when(n % 9 == 0, F.col("source")).otherwise(F.concat(F.lit("IX-DOC-N"), n.cast("string"), F.lit("-2024"))).alias("doc_id"),
        F.when(F.col("status") == "binding", "core").when(F.col("status") == "advisory", "referenced").when(n % 4 == 0, "extended").otherwise("method").alias("tier"),
        F.when(n % 6 != 0, F.concat(F.lit("https://x.test/"), n.cast("string"))).alias("url"),
        F.when(n % 8 == 0, F.upper(digest)).when(n % 10 != 0, digest).alias("sha256"),
        F.when(n % 7 != 0, F.concat(F.lit("raw/"), n.cast("string"))).alias("local_path"),
        F.when(n % 12 == 0, F.date_format("fetched_at", "dd/MM/yyyy")).otherwise(F.date_format("fetched_at", "yyyy-MM-dd")).alias("url_accessed"),
        F.when(n % 14 == 0, "Held. Copied.  Held.").when(n % 15 == 0, "Two\nlines.").otherwise(F.lit("Held. Copied.")).alias("notes"),
    )


def register_guard(spark: SparkSession, d: str) -> DataFrame:
    """How often each fault occurs in a register."""
    return records.guard(_register(spark, d), 15).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"))


def chosen_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents of chosen states and languages, however these are written."""
    docs = table(spark, d, "documents").select("doc_id", "status", "lang")
    return records.matching(records.matching(docs, "status", [" Binding", "DRAFT "]), "lang", ["EN", "fr"])


def tier_census(spark: SparkSession, d: str) -> DataFrame:
    """Records of each known tier."""
    return _register(spark, d).where(F.col("tier").isin(records.TIERS)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the tables that reports need have rows; withdrawn findings of no clause stand for an empty one."""
    t = lambda n: table(spark, d, n)
    return records.readiness({"findings": t("findings_sample"), "clauses": t("clauses"), "controls": t("controls"), "none": t("findings_sample").where("line_no < 0")})


def source_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Per family of controls the fingerprint of their keys in order."""
    c = active_controls(spark, d, "family").groupBy("family").agg(F.array_sort(F.collect_list("control_id")).alias("ids"))
    return c.select("family", fingerprint(F.col("ids")).alias("fingerprint"))


def encoded_register(spark: SparkSession, d: str) -> DataFrame:
    """Controls as a register's text columns: lists joined, booleans as words, null as empty."""
    return records.encode(active_controls(spark, d, "is_enhancement", "parent_id", "related", "n_params").select("control_id", "is_enhancement", "parent_id", "related", "n_params"))


def decoded_register(spark: SparkSession, d: str) -> DataFrame:
    """The encoded register typed again."""
    e = encoded_register(spark, d)
    out = records.decode(e, {"related": "string"}, ("is_enhancement",), ("n_params",))
    return out.select("control_id", "is_enhancement", "parent_id", F.array_join("related", "|").alias("related"), "n_params")


def key_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """For keys in findings that no control has: up to 10 controls whose key contains the same letters and number."""
    known = table(spark, d, "controls").select(norm_key("control_id").alias("control")).distinct()
    asked = _findings(spark, d).select("control").where("control is not null").distinct().join(known, "control", "left_anti")
    stem = lambda c: F.nullif(F.regexp_extract(c, r"^([A-Z]+-[0-9]+)", 1), F.lit(""))
    near = asked.select("control", stem("control").alias("stem")).join(known.select(F.col("control").alias("suggestion"), stem("control").alias("stem")), "stem")
    listed = near.groupBy("control").agg(F.slice(F.array_sort(F.collect_set("suggestion")), 1, 10).alias("s"))
    return listed.select("control", F.array_join("s", "|").alias("suggestions"))


def record_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the register's order: by rank of status, then id; with their place."""
    rank = F.when(F.col("status") == "binding", 0).when(F.col("status") == "advisory", 1).when(F.col("status") == "draft", 2).otherwise(3)
    docs = table(spark, d, "documents").select("doc_id", "status", rank.alias("rank"))
    return places(docs, F.asc("rank"), F.asc("doc_id")).select("doc_id", "status", "place")


_F = r"""f AS (SELECT line_no, i AS finding_no, nullif(upper(trim(clause_id)), '') AS clause, subdomain, nullif(upper(trim(f.control_id)), '') AS control, regexp_replace(lower(trim(f.relationship)), '\s+', '_', 'g') AS relationship, f.confidence AS confidence, f.status AS status, f.parameter_gap AS parameter_gap
  FROM (SELECT line_no, clause_id, subdomain, findings[i] AS f, i FROM (SELECT *, unnest(range(1, len(findings) + 1))::INT AS i FROM findings_sample)) WHERE f IS NOT NULL)"""
_JUDGED = "jl AS (SELECT upper(trim(clause_id)) AS clause, coalesce(findings, []) AS findings FROM findings_sample WHERE trim(clause_id) <> '' AND coalesce(parse_error, '') = '' QUALIFY row_number() OVER (PARTITION BY upper(trim(clause_id)) ORDER BY line_no DESC) = 1)"
_MAPPABLE = r"""mp AS (SELECT upper(trim(clause_id)) AS clause, framework, subdomain, subdomain_title, has_numeric_param, clause_type = 'referential' AS referential,
  coalesce(deontic IS NULL AND parent_id IN (SELECT clause_id FROM cla) AND length(text) < 70 AND (text LIKE '%;' OR text LIKE '%.')
    AND NOT regexp_matches(text, '(?i)\b(is|are|was|were|be|been|shall|should|must|may|will|can)\b') AND NOT regexp_matches(text, '(?i)\b\w+(ing|ed|es|s)\b\s+(for|to|by|with|in|on|that|the)\b'), false) AS listed FROM cla)"""
_STATES = f"""{_CLA}, {_JUDGED}, {_MAPPABLE},
ex AS (SELECT DISTINCT framework, subdomain, split_part(upper(trim(r.control_id)), '-', 1) AS family FROM review r JOIN mp ON mp.clause = upper(trim(r.clause_id)) WHERE label = 'correct' AND trim(r.control_id) <> ''),
rc AS (SELECT DISTINCT upper(trim(clause_id)) AS clause, split_part(upper(trim(control_id)), '-', 1) AS family FROM candidates WHERE trim(clause_id) <> '' AND trim(control_id) <> ''),
ts AS (SELECT DISTINCT rc.clause FROM rc JOIN mp ON mp.clause = rc.clause JOIN ex ON ex.framework = mp.framework AND ex.subdomain = mp.subdomain AND ex.family = rc.family),
st AS (SELECT jl.clause, coalesce(framework, '') AS framework, coalesce(subdomain, '') AS subdomain, coalesce(subdomain_title, '') AS title, len(list_filter(findings, lambda x: x IS NOT NULL)) AS nf, len(list_filter(findings, lambda x: x.status = 'accepted')) > 0 AS accepted,
  len(list_filter(findings, lambda x: x.status = 'disputed')) > 0 AS disputed, greatest(0.0::DOUBLE, coalesce(list_max(list_transform(list_filter(findings, lambda x: x.status = 'disputed'), lambda x: coalesce(x.confidence, 0.0))), 0.0)) AS best,
  len(list_filter(findings, lambda x: x IS NOT NULL)) > 0 OR jl.clause IN (SELECT clause FROM ts) AS tested
  FROM jl LEFT JOIN mp ON mp.clause = jl.clause WHERE NOT coalesce(listed, false) AND NOT coalesce(referential, false))"""
_BEST = f"""WITH {_CLA}, {_JUDGED}, p AS (SELECT clause, bool_or(coalesce(f.parameter_gap, false)) AS has_gap, count(*) AS n_accepted, max(coalesce(f.confidence, 0)) AS top FROM (SELECT clause, unnest(findings) AS f FROM jl) WHERE f.status = 'accepted' GROUP BY 1)"""
_REG = """reg AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'XX-DUP-ID-2020' WHEN doc_id % 9 = 0 THEN source ELSE 'IX-DOC-N' || doc_id || '-2024' END AS doc_id,
  CASE WHEN status = 'binding' THEN 'core' WHEN status = 'advisory' THEN 'referenced' WHEN doc_id % 4 = 0 THEN 'extended' ELSE 'method' END AS tier, CASE WHEN doc_id % 6 <> 0 THEN 'https://x.test/' || doc_id END AS url,
  CASE WHEN doc_id % 8 = 0 THEN upper(sha256(coalesce(text, ''))) WHEN doc_id % 10 <> 0 THEN sha256(coalesce(text, '')) END AS sha256, CASE WHEN doc_id % 7 <> 0 THEN 'raw/' || doc_id END AS local_path,
  CASE WHEN doc_id % 12 = 0 THEN strftime(fetched_at, '%d/%m/%Y') ELSE strftime(fetched_at, '%Y-%m-%d') END AS url_accessed, CASE WHEN doc_id % 14 = 0 THEN 'Held. Copied.  Held.' WHEN doc_id % 15 = 0 THEN 'Two' || chr(10) || 'lines.' ELSE 'Held. Copied.' END AS notes FROM documents)"""
_LAST = "(SELECT * FROM controls QUALIFY row_number() OVER (PARTITION BY control_id ORDER BY loaded_at DESC) = 1)"


def queries() -> dict:
    names = "clause_statistics catalogue_families family_coverage clause_coverage clause_gaps family_gaps clause_order overview overall broader_targets parameter_gaps followed_families enumerations evidenced_absence best_examples best_example record_problems record_guard record_repeats record_tallies related_tallies issuer_sources uncovered_years hash_drift sniffed_formats register_guard chosen_records tier_census readiness source_fingerprints encoded_register decoded_register key_suggestions record_order"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    followed = ", ".join(f"'{x}'" for x in FOLLOWED)
    kinds = ", ".join(f"count(*) FILTER (clause_type = '{k}') AS {k}" for k in KINDS)
    p = SCHEMA["properties"]
    langs, states = (", ".join(f"'{x}'" for x in p[c]["enum"]) for c in ("lang", "status"))
    return {
        "clause_statistics": f"WITH {_CLA} SELECT framework, subdomain, {kinds}, count(*) AS n, count(*) FILTER (has_numeric_param) AS n_with_value, count(deontic) AS n_modal, max(level) AS depth, array_to_string(list_transform(string_split(subdomain, '.'), lambda x: lpad(x, 4, '0')), '.') AS sort_key FROM cla GROUP BY 1, 2",
        "catalogue_families": f"""WITH c AS (SELECT *, withdrawn_at IS NULL AND NOT withdrawn AS held FROM {_LAST})
SELECT family, count(*) FILTER (held AND NOT is_enhancement) AS n_base, count(*) FILTER (held AND is_enhancement) AS n_enhancements, coalesce(sum(n_params) FILTER (held), 0)::BIGINT AS n_params, coalesce(sum(len(related)) FILTER (held), 0)::BIGINT AS n_related, count(*) FILTER (NOT held) AS n_withdrawn FROM c GROUP BY 1""",
        "family_coverage": f"""WITH {_CTL}, {_F}, g AS (SELECT family, count(*) AS n, count(*) FILTER (upper(trim(control_id)) NOT IN (SELECT control FROM f WHERE status = 'accepted' AND control IS NOT NULL)) AS n_unmatched,
  count(*) FILTER (upper(trim(control_id)) NOT IN (SELECT upper(trim(control_id)) FROM candidates WHERE trim(control_id) <> '')) AS n_unreached FROM ctl GROUP BY 1)
SELECT *, round_even(100 * n_unmatched / n, 0)::INT AS unmatched_percent, round_even(100 * n_unreached / n, 0)::INT AS unreached_percent FROM g""",
        "clause_coverage": f"""WITH {_STATES}, g AS (SELECT framework, subdomain, max(title) AS title, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted AND disputed) AS n_review,
  count(*) FILTER (NOT accepted AND NOT disputed AND tested) AS n_nothing, count(*) FILTER (NOT accepted AND NOT disputed AND NOT tested) AS n_untested, count(*) AS n FROM st GROUP BY 1, 2)
SELECT *, round_even(100 * n_nothing / n, 0)::INT AS nothing_percent, CASE WHEN n_nothing > greatest(n_review, n_untested) THEN 'evidenced absence' WHEN n_untested > n_review THEN 'not tested' WHEN n_review > 0 THEN 'below threshold' ELSE 'covered' END AS kind FROM g""",
        "clause_gaps": f"""WITH {_STATES}, g AS (SELECT clause, framework, subdomain, CASE WHEN nf > 0 THEN 'below threshold' WHEN tested THEN 'evidenced absence' ELSE 'not tested' END AS severity, best FROM st WHERE NOT accepted),
x AS (SELECT *, count(*) FILTER (severity = 'evidenced absence') OVER (PARTITION BY framework, subdomain) AS density FROM g)
SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'evidenced absence' THEN 0 WHEN 'not tested' THEN 1 ELSE 2 END, density DESC, subdomain, best, clause) AS place FROM x""",
        "family_gaps": f"""WITH {_CTL}, {_F}, g AS (SELECT family, count(*) AS n, count(*) FILTER (upper(trim(control_id)) NOT IN (SELECT control FROM f WHERE status = 'accepted' AND control IS NOT NULL)) AS n_unmatched,
  count(*) FILTER (upper(trim(control_id)) NOT IN (SELECT control FROM f WHERE status IN ('accepted', 'disputed') AND control IS NOT NULL)) AS n_unreached FROM ctl GROUP BY 1),
p AS (SELECT *, round_even(100 * n_unmatched / n, 0)::INT AS unmatched_percent, round_even(100 * n_unreached / n, 0)::INT AS unreached_percent FROM g)
SELECT *, row_number() OVER (ORDER BY unreached_percent DESC, unmatched_percent DESC, family) AS place FROM p""",
        "clause_order": f"""WITH {_CLA}, {_JUDGED} SELECT clause, framework, subdomain, row_number() OVER (ORDER BY framework, list_transform(string_split(subdomain, '.'), lambda x: x::INT), clause) AS place FROM jl JOIN cla ON upper(trim(clause_id)) = clause""",
        "overview": rf"""WITH {_STATES}, jf AS (SELECT clause, unnest(findings) AS f FROM jl),
x AS (SELECT regexp_replace(lower(trim(f.relationship)), '\s+', '_', 'g') AS r, f.status AS status, f.parameter_gap AS pg, coalesce(has_numeric_param, false) AS v FROM jf LEFT JOIN mp USING (clause) WHERE f IS NOT NULL),
a AS (SELECT count(*) AS n_mappable, count(*) FILTER (accepted) AS n_covered, count(*) FILTER (NOT accepted AND nf = 0 AND tested) AS n_absent, count(*) FILTER (NOT accepted AND NOT tested) AS n_untested, count(*) FILTER (NOT accepted AND nf > 0) AS n_below FROM st),
b AS (SELECT count(*) AS n_findings, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'disputed') AS n_disputed, count(*) FILTER (status IN ('accepted', 'disputed') AND r = 'superset_of') AS n_broader,
  count(*) FILTER (status = 'accepted' AND pg AND v) AS n_hard, count(*) FILTER (status = 'accepted' AND pg AND NOT v) AS n_soft, count(*) FILTER (status IN ('accepted', 'disputed') AND r IN ('equal', 'subset_of')) AS n_aligned, count(*) FILTER (status IN ('accepted', 'disputed')) AS n_verified FROM x),
c AS (SELECT count(*) FILTER (coalesce(listed, false) OR coalesce(referential, false)) AS n_left_out FROM jl LEFT JOIN mp USING (clause))
SELECT *, (100 * n_covered // greatest(n_mappable, 1))::BIGINT AS covered_percent, n_findings - n_accepted - n_disputed AS n_rejected FROM a, b, c""",
        "overall": f"WITH {_CTL}, {_CLA}, {_F} SELECT *, n_controls * n_clauses AS n_pairs FROM (SELECT count(*) AS n_controls FROM ctl), (SELECT count(*) AS n_clauses FROM cla), (SELECT count(*) AS n_candidates FROM candidates), (SELECT count(*) AS n_findings FROM f), (SELECT count(*) AS n_documents FROM documents)",
        "broader_targets": rf"""WITH {_CLA}, {_F}, t AS (SELECT upper(trim(clause_id)) AS clause, CASE WHEN length(text) <= 40 THEN text WHEN contains(substr(text, 1, 40), ' ') THEN regexp_extract(substr(text, 1, 40), '^(.*) [^ ]*$', 1) || '…' ELSE substr(text, 1, 40) || '…' END AS short FROM cla)
SELECT line_no, finding_no, f.clause, control, confidence, short FROM f LEFT JOIN t ON t.clause = f.clause WHERE relationship = 'superset_of' AND status IN ('accepted', 'disputed')""",
        "parameter_gaps": f"WITH {_CLA}, {_F} SELECT CASE WHEN has_numeric_param THEN 'hard' ELSE 'soft' END AS kind, status, count(*) AS n FROM f LEFT JOIN cla ON upper(trim(clause_id)) = clause WHERE parameter_gap GROUP BY 1, 2",
        "followed_families": f"""WITH {_CTL}, {_F}, m AS (SELECT control, count(*) AS nf, count(*) FILTER (status = 'accepted') AS na FROM f GROUP BY 1)
SELECT family, count(*) AS n_controls, count(nf) AS n_found, count(*) FILTER (na > 0) AS n_accepted FROM ctl LEFT JOIN m ON control = upper(trim(control_id)) WHERE family IN ({followed}) GROUP BY 1""",
        "enumerations": f"WITH {_CLA}, {_MAPPABLE} SELECT framework, count(*) AS n, count(*) FILTER (listed) AS n_listed FROM mp GROUP BY 1",
        "evidenced_absence": f"WITH {_STATES} SELECT clause, framework, subdomain, tested, count(*) FILTER (tested) OVER (PARTITION BY framework, subdomain) AS density FROM st WHERE NOT accepted",
        "best_examples": f"{_BEST} SELECT framework, subdomain, clause, has_gap, n_accepted, top FROM p JOIN cla ON upper(trim(clause_id)) = clause QUALIFY row_number() OVER (PARTITION BY framework, subdomain ORDER BY has_gap DESC, n_accepted DESC, top DESC, clause DESC) = 1",
        "best_example": f"{_BEST} SELECT has_gap, n_accepted, top, clause FROM p JOIN cla ON upper(trim(clause_id)) = clause ORDER BY has_gap DESC, n_accepted DESC, top DESC, clause DESC LIMIT 1",
        "record_problems": f"""SELECT doc_id, problems FROM (SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id IS NULL THEN 'missing doc_id' END, CASE WHEN coalesce(text, '') = '' THEN 'missing text' END, CASE WHEN coalesce(lang, '') = '' THEN 'missing lang' END, CASE WHEN coalesce(issuing_body, '') = '' THEN 'missing issuing_body' END,
  CASE WHEN doc_id < 1 THEN 'doc_id: below minimum' END, CASE WHEN length(text) < 20 THEN 'text: too short' END, CASE WHEN lang NOT IN ({langs}) THEN 'lang: not in list' END,
  CASE WHEN NOT regexp_matches(source, '^(?:{p['source']['pattern']})') THEN 'source: pattern' END, CASE WHEN length(title_en) < 3 THEN 'title_en: too short' END,
  CASE WHEN status NOT IN ({states}) THEN 'status: not in list' END, CASE WHEN year < 2012 THEN 'year: below minimum' END, CASE WHEN year > 2025 THEN 'year: above maximum' END], lambda x: x IS NOT NULL), '|') AS problems FROM documents) WHERE problems <> ''""",
        "record_guard": r"""WITH s AS (SELECT *, list_filter(list_transform(string_split_regex(text, '[.!?]\s+'), lambda x: lower(trim(regexp_replace(x, '[.!?\s]+', ' ', 'g')))), lambda x: x <> '') AS l FROM documents)
SELECT status, count(*) AS n, count(*) FILTER (regexp_matches(title_en, '[\r\n]')) AS n_broken_titles, count(*) FILTER (len(list_distinct(l)) < len(l)) AS n_repeating, count(*) FILTER (coalesce(lang, 'und') = 'und') AS n_no_language, count(*) FILTER (n_chars <> length(text)) AS n_miscounted FROM s GROUP BY 1""",
        "record_repeats": "SELECT doc_id, first_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents WHERE text <> '') WHERE doc_id > first_doc_id",
        "record_tallies": " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM documents GROUP BY 2" for c in ("status", "lang", "issuing_body", "year")),
        "related_tallies": f"WITH {_CTL} SELECT 'related_family' AS field, split_part(r, '-', 1) AS value, count(*) AS n FROM (SELECT unnest(related) AS r FROM ctl) GROUP BY 2",
        "issuer_sources": "SELECT issuing_body, string_agg(DISTINCT split_part(source, '-', 2), ', ' ORDER BY split_part(source, '-', 2)) AS kinds, count(DISTINCT source) AS n_sources FROM documents WHERE issuing_body IS NOT NULL AND source IS NOT NULL GROUP BY 1",
        "uncovered_years": f"SELECT y::INT AS year, count(doc_id) AS n FROM (SELECT unnest(range({YEARS[0]}, {YEARS[1]})) AS y) LEFT JOIN documents ON year = y AND status = 'binding' GROUP BY 1",
        "hash_drift": """WITH h AS (SELECT doc_id, sha256(text) AS d FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(d) ELSE d END AS d FROM h WHERE doc_id % 7 <> 0), n AS (SELECT * FROM h WHERE doc_id % 13 <> 0)
SELECT CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN o.d IS NULL THEN 'new' WHEN o.d IS NOT DISTINCT FROM n.d THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1""",
        "sniffed_formats": r"""WITH x AS (SELECT coalesce(doc_id % 17 = 0 OR starts_with(text, '%PDF-'), false) AS magic,
  CASE doc_id % 11 WHEN 3 THEN 'html' WHEN 4 THEN 'openxmlformats-officedocument.wordprocessing' WHEN 5 THEN 'spreadsheet' WHEN 6 THEN 'text/plain' WHEN 7 THEN 'pdf' ELSE '' END AS ct, doc_id % 7 AS e FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN magic THEN 'pdf' WHEN ct = 'pdf' OR e = 4 THEN 'pdf' WHEN ct = 'html' OR e IN (0, 1) THEN 'html' WHEN ct LIKE 'openxml%' OR e = 2 THEN 'docx' WHEN ct = 'spreadsheet' OR e = 3 THEN 'xlsx' WHEN ct = 'text/plain' THEN 'txt' ELSE 'unknown' END AS format, count(*) AS n FROM x GROUP BY 1""",
        "register_guard": rf"""WITH {_REG}, e AS (
  SELECT doc_id, unnest([CASE WHEN contains(notes, chr(10)) THEN 'line break in notes' END,
    CASE WHEN NOT coalesce(regexp_matches(doc_id, '^[A-Z]{{2,4}}-[A-Z0-9]{{2,12}}-[A-Z0-9]{{2,20}}-[0-9]{{4}}$'), false) THEN 'bad doc_id' END, CASE WHEN tier NOT IN ('core', 'referenced', 'method') THEN 'unknown tier' END,
    CASE WHEN tier = 'core' AND url IS NULL THEN 'core record without url' END, CASE WHEN tier = 'core' AND sha256 IS NULL THEN 'core record without sha256' END, CASE WHEN tier = 'core' AND local_path IS NULL THEN 'core record without local_path' END, CASE WHEN tier = 'core' AND url_accessed IS NULL THEN 'core record without url_accessed' END,
    CASE WHEN NOT regexp_matches(sha256, '^[a-f0-9]{{64}}$') THEN 'malformed sha256' END, CASE WHEN NOT regexp_matches(url_accessed, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'bad date' END,
    CASE WHEN notes LIKE 'Held. Copied.  Held.' THEN 'sentence twice in notes' END, CASE WHEN tier IN ('referenced', 'method') AND url IS NULL THEN 'record without url' END]) AS error FROM reg
  UNION ALL SELECT NULL, 'duplicate doc_id' FROM (SELECT count(DISTINCT doc_id) < count(doc_id) AS t FROM reg) WHERE t
  UNION ALL SELECT NULL, 'row count ' || n || ' is not 15' FROM (SELECT count(*) AS n FROM reg) WHERE n <> 15)
SELECT error, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM e WHERE error IS NOT NULL GROUP BY 1""",
        "chosen_records": "SELECT doc_id, status, lang FROM documents WHERE lower(trim(status)) IN ('binding', 'draft') AND lower(trim(lang)) IN ('en', 'fr')",
        "tier_census": f"WITH {_REG} SELECT tier, count(*) AS n FROM reg WHERE tier IN ('core', 'referenced', 'method') GROUP BY 1",
        "readiness": "SELECT (SELECT count(*) > 0 FROM findings_sample) AND (SELECT count(*) > 0 FROM clauses) AND (SELECT count(*) > 0 FROM controls) AND false AS ready, 'none' AS missing",
        "source_fingerprints": f"WITH {_CTL} SELECT family, substr(sha256(string_agg(control_id, '' ORDER BY control_id)), 1, 16) AS fingerprint FROM ctl GROUP BY 1",
        "encoded_register": f"WITH {_CTL} SELECT control_id, is_enhancement::VARCHAR AS is_enhancement, coalesce(parent_id, '') AS parent_id, coalesce(array_to_string(related, ';'), '') AS related, coalesce(n_params::VARCHAR, '') AS n_params FROM ctl",
        "decoded_register": f"WITH {_CTL} SELECT control_id, is_enhancement, parent_id, nullif(array_to_string(related, '|'), '') AS related, n_params::BIGINT AS n_params FROM ctl",
        "key_suggestions": rf"""WITH {_F}, k AS (SELECT DISTINCT upper(trim(control_id)) AS control FROM controls WHERE trim(control_id) <> ''), a AS (SELECT DISTINCT control FROM f WHERE control IS NOT NULL AND control NOT IN (SELECT control FROM k)),
m AS (SELECT a.control, k.control AS s FROM a JOIN k ON regexp_extract(a.control, '^([A-Z]+-[0-9]+)', 1) = regexp_extract(k.control, '^([A-Z]+-[0-9]+)', 1) WHERE regexp_extract(a.control, '^([A-Z]+-[0-9]+)', 1) <> '')
SELECT control, array_to_string(list_sort(list(s))[1:10], '|') AS suggestions FROM m GROUP BY 1""",
        "record_order": "SELECT doc_id, status, row_number() OVER (ORDER BY CASE status WHEN 'binding' THEN 0 WHEN 'advisory' THEN 1 WHEN 'draft' THEN 2 ELSE 3 END, doc_id) AS place FROM documents",
    }
