"""Queries over documents and raw answers: pages, lines, chunks, clauses, patterns, HTML, JSON, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.functions.text import IDENTIFIER, MODAL, REFERENTIAL, VALUE, identifiers, modal, tokens, values
from alinea.operators import parsing
from alinea.operators.current import current
from alinea.operators.hierarchy import children, path_order
from alinea.plans.retrieval import _tok
from alinea.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every document."""
    p = parsing.pages(_docs(spark, d), "doc_id", "text")
    return p.select("doc_id", "place", "page", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Documents put together from their pages again, those of 200 characters or more."""
    out = parsing.assemble(parsing.pages(_docs(spark, d), "doc_id", "text"), "doc_id")
    return out.select("doc_id", "n_pages", F.md5("text").alias("text_md5"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document without running headers and footers."""
    lines = parsing.body_lines(parsing.pages(_docs(spark, d), "doc_id", "text"), "doc_id")
    return lines.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").alias("last_line"))


def guidance_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines behind a document's first guidance line and before the next line that is all capitals behind an identifier."""
    lines = parsing.body_lines(parsing.pages(_docs(spark, d), "doc_id", "text"), "doc_id")
    inside = parsing.trimmed_range(lines, "doc_id", r"^Guidance:", r"^[A-Z]{2}-[0-9]+(\([0-9]+\))? [A-Z -]+$")
    return inside.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all pages with their documents' metadata."""
    meta = ("title_en", "issuing_body", "status")
    docs = _docs(spark, d).select("doc_id", "text", *[F.coalesce(c, F.lit("")).alias(c) for c in meta], "year")
    return parsing.chunks(docs, "doc_id", "text", keep=(*meta, "year"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per source: chunks, their lengths, and their tokens."""
    c = parsing.chunks(_docs(spark, d), "doc_id", "text", keep=("source",)).select("source", F.length("chunk").alias("c"), F.size(tokens("chunk")).alias("t"))
    sizes = [e for x, n in (("c", "chars"), ("t", "tokens")) for e in (F.min(x).alias(f"least_{n}"), F.expr(f"sum({x}) div count(1)").alias(f"mean_{n}"), F.max(x).alias(f"most_{n}"))]
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), *sizes)


def document_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Numbered clauses of all documents, with what their texts say: modal verb, values, kind."""
    c = parsing.clauses(_docs(spark, d), "doc_id", "text")
    return c.withColumn("deontic", modal("text")).withColumn("numeric_params", values("text"))


def first_modal(spark: SparkSession, d: str) -> DataFrame:
    """Each clause row's first modal verb."""
    return table(spark, d, "clauses").select("clause_id", "loaded_at", modal("text").alias("deontic")).distinct()


def stated_values(spark: SparkSession, d: str) -> DataFrame:
    """How often each concrete value or period occurs in how many clause rows."""
    v = table(spark, d, "clauses").select("clause_id", F.explode(values("text")).alias("value"))
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("clause_id").alias("n_clauses"))


def clause_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Clauses by kind: stems have children and end in a colon or semicolon, referential ones point elsewhere."""
    c = current(table(spark, d, "clauses"), "clause_id", "loaded_at", "retired_at").drop("n_children", "child_ids")
    c = c.join(children(c, "clause_id", "parent_id", path_order("path")), "clause_id")
    stem = (F.col("n_children") > 0) & F.col("text").rlike(r"[:;]\s*$")
    points = F.col("text").rlike(REFERENTIAL)
    kind = F.when(stem, "stem").when((F.col("clause_type") == "referential") | points, "referential").otherwise(F.when(F.col("clause_type") == "stem", "substantive").otherwise(F.col("clause_type")))
    return c.groupBy("level", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_numeric_param").alias("n_with_value"))


def identifier_harvest(spark: SparkSession, d: str) -> DataFrame:
    """The 12 identifiers that documents name most often."""
    i = _docs(spark, d).select("doc_id", F.explode(identifiers("text")).alias("identifier"))
    return i.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")).orderBy(F.desc("n"), "identifier").limit(12)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per status: documents, characters (least, mean, most) and how many texts are null or empty."""
    n = F.length("text")
    return _docs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n_docs"), F.min(n).alias("least"), F.expr("sum(length(text)) div count(text)").alias("mean"), F.max(n).alias("most"), F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("n_empty"))


def html_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as HTML pages with scripts, navigation and entities, and read back."""
    esc = F.replace(F.replace(F.replace(F.replace("text", F.lit("\r"), F.lit("\n")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><nav>Home</nav><main><h1>Top</h1><p>"), esc, F.lit("</p><br><script>if (a < b) {}</script></main><footer>End</footer></body></html>"))
    out = parsing.html_column(_docs(spark, d).select("doc_id", page.alias("page")), "doc_id", "page")
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers as JSON arrays: objects in each, or the error."""
    objects, error = parsing.json_array("payload")
    return table(spark, d, "findings_raw").select("line_no", error.alias("error"), F.coalesce(F.size(objects), F.lit(0)).alias("n_objects"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Controls nested into one catalogue a family and flattened again."""
    c = table(spark, d, "controls").groupBy("control_id").agg(F.max_by(F.struct("*"), "loaded_at").alias("r")).select("r.*")
    prop = lambda n, v, k: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(k).alias("class"))
    part = lambda n, v, *inner: F.struct(F.lit(n).alias("name"), v.alias("prose"), *inner)
    padded = F.regexp_replace("control_id", "-([0-9])\\b", "-0$1")
    props = F.array(prop("label", padded, "zero-padded"), prop("label", F.col("control_id"), "sp"), prop("status", F.when(F.col("withdrawn"), F.lit("withdrawn")).otherwise(F.lit("active")), ""))
    # The statement has an inner part that names the last parameter, and an assessment that must not come out.
    names = F.concat(F.lit("See {{ insert: param, "), F.element_at("param_ids", -1), F.lit(" }} and {{insert: param, none}}."))
    inner = F.array(F.struct(F.lit("item").alias("name"), F.when(F.size("param_ids") > 0, names).alias("prose"), F.array(prop("label", F.lit("a."), "")).alias("props")), F.struct(F.lit("assessment").alias("name"), F.lit("Never said.").alias("prose"), F.array(prop("label", F.lit("x."), "")).alias("props")))
    node = [
        F.col("oscal_id").alias("id"), "title", props.alias("props"), F.array(part("statement", F.col("statement"), inner.alias("parts")), part("guidance", F.col("guidance"), F.lit(None).cast("array<struct<name: string, prose: string, props: array<struct<name: string, value: string, class: string>>>>").alias("parts"))).alias("parts"),
        F.zip_with("param_ids", "params", lambda i, p: F.struct(i.alias("id"), p.alias("label"))).alias("params"),
        F.transform("related", lambda r: F.struct(F.lit("related").alias("rel"), F.concat(F.lit("#"), F.lower(r)).alias("href"))).alias("links"),
    ]
    kids = c.where("is_enhancement").groupBy("parent_id").agg(F.collect_list(F.struct(*node)).alias("controls"))
    base = c.where("not is_enhancement").alias("c").join(kids.withColumnRenamed("parent_id", "control_id"), "control_id", "left")
    nested = base.groupBy("family").agg(F.min("family_title").alias("title"), F.collect_list(F.struct(*node, "controls")).alias("controls"))
    group = F.struct(F.array(F.struct(F.col("family").alias("id"), "title", "controls")).alias("groups"))
    docs = nested.select("family", F.to_json(F.struct(group.alias("catalog"))).alias("doc"))
    flat = parsing.flatten_catalogue(docs.withColumnRenamed("family", "k"), "k", "doc")
    return flat.select("control_id", "oscal_id", "family", "title", "is_enhancement", "parent_id", "withdrawn", "statement", "guidance", "n_params", F.array_join("params", "|").alias("params"), F.array_join("related", "|").alias("related"))


_PAGED = """pg AS (SELECT doc_id, unnest(CASE WHEN len(nums) > 0 THEN list_transform(range(1, len(nums) + 1), lambda i: {'place': i, 'page': nums[i]::INT, 'body': parts[i + 1]}) ELSE [{'place': 1, 'page': 1, 'body': text}] END) AS p
  FROM (SELECT doc_id, text, regexp_extract_all(text, '<<<PAGE ([0-9]+)>>>\\n', 1) AS nums, string_split_regex(text, '<<<PAGE [0-9]+>>>\\n') AS parts FROM documents WHERE text IS NOT NULL)),
pages AS (SELECT doc_id, p.place AS place, p.page AS page, p.body AS body FROM pg)"""
_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _ends(a: str) -> str:
    """SQL for where the window that begins at ``a`` ends: behind the last break of the best kind in its later half."""
    s = f"substr(body, {a} + 1, 1200)"
    last = lambda m: f"length(regexp_extract({s}, '(?s)^(.*){m}', 1))"
    kinds = [(r"\n\n", "chr(10) || chr(10)", 2), (r"\n", "chr(10)", 1), (r"\. ", "'. '", 2), (" ", "' '", 1)]
    whens = " ".join(f"WHEN contains({s}, {c}) AND {last(m)} > 600 THEN {a} + {last(m)} + {n}" for m, c, n in kinds)
    return f"CASE WHEN {a} + 1200 >= length(body) THEN length(body) {whens} ELSE {a} + 1200 END"


_CHUNKS = f"""WITH RECURSIVE {_PAGED}, w AS (
  SELECT doc_id, place, page, 0::BIGINT AS a, {_ends('0')} AS z FROM pages WHERE length(body) > 0
  UNION ALL SELECT doc_id, place, page, a, {_ends('a')} FROM (SELECT p.doc_id, p.place, p.page, p.body, CASE WHEN w.z - 150 > w.a THEN w.z - 150 ELSE w.a + 600 END AS a
    FROM w JOIN pages p ON p.doc_id = w.doc_id AND p.place = w.place WHERE w.z < length(p.body))),
cut AS (SELECT w.doc_id, w.place, w.page, a, substr(body, a + 1, z - a) AS raw FROM w JOIN pages p ON p.doc_id = w.doc_id AND p.place = w.place),
bare AS (SELECT *, regexp_replace(raw, '^{_BLANKS}+', '') AS l, regexp_replace(regexp_replace(raw, '^{_BLANKS}+', ''), '{_BLANKS}+$', '') AS chunk FROM cut),
ch AS (SELECT doc_id, page, a::INT AS char_start, (a + length(chunk))::INT AS char_end, (a + length(raw) - length(l))::INT AS span_start, (a + length(raw) - length(l) + length(chunk))::INT AS span_end, chunk,
  row_number() OVER (PARTITION BY doc_id ORDER BY place, a) AS k FROM bare WHERE chunk <> '')"""
_LINES = rf"""lines AS (SELECT doc_id, place, line_no, line FROM (
  SELECT doc_id, place, i AS line_no, regexp_replace(regexp_replace(ls[i], '{parsing.NOISE_INLINE}', ' ', 'g'), '\s+$', '') AS line
  FROM (SELECT doc_id, place, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, place, string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM pages)))
  WHERE NOT regexp_matches(line, '{parsing.NOISE_LINE}') AND NOT regexp_matches(line, '^\s*$'))"""


def queries() -> dict:
    names = "document_pages assembled page_lines guidance_lines document_chunks chunk_stats document_clauses first_modal stated_values clause_kinds identifier_harvest corpus_stats html_lines json_answers catalogue"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    space = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
    return {
        "document_pages": f"WITH {_PAGED} SELECT doc_id, place, page, length(body) AS n_chars, md5(body) AS body_md5 FROM pages",
        "assembled": f"WITH {_PAGED} SELECT doc_id, count(*) AS n_pages, md5(string_agg('<<<PAGE ' || page || '>>>' || chr(10) || body, '' ORDER BY place)) AS text_md5 FROM pages GROUP BY 1 HAVING sum(length(body)) >= 200",
        "page_lines": f"WITH {_PAGED}, {_LINES} SELECT doc_id, place, count(*) AS n_lines, sum(length(line)) AS n_chars, max(line_no) AS last_line FROM lines GROUP BY 1, 2",
        "guidance_lines": rf"""WITH {_PAGED}, {_LINES}, a AS (SELECT doc_id, min(struct_pack(place, line_no)) AS a FROM lines WHERE regexp_matches(line, '^Guidance:') GROUP BY 1),
i AS (SELECT l.*, struct_pack(place, line_no) AS spot FROM lines l JOIN a ON a.doc_id = l.doc_id WHERE struct_pack(place, line_no) > a.a),
z AS (SELECT doc_id, min(spot) AS z FROM i WHERE regexp_matches(line, '^[A-Z]{{2}}-[0-9]+(\([0-9]+\))? [A-Z -]+$') GROUP BY 1)
SELECT i.doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM i LEFT JOIN z ON z.doc_id = i.doc_id WHERE z IS NULL OR spot < z GROUP BY 1""",
        "document_chunks": f"""{_CHUNKS} SELECT printf('%d::p%d::c%04d', ch.doc_id, ch.page, k) AS chunk_id, ch.doc_id, ch.page, char_start, char_end, span_start, span_end, chunk,
  coalesce(title_en, '') AS title_en, coalesce(issuing_body, '') AS issuing_body, coalesce(status, '') AS status, year FROM ch JOIN documents d ON d.doc_id = ch.doc_id""",
        "chunk_stats": f"""{_CHUNKS}, s AS (SELECT source, length(chunk) AS c, len({_tok('chunk')}) AS t FROM ch JOIN documents d ON d.doc_id = ch.doc_id)
SELECT source, count(*) AS n_chunks, min(c) AS least_chars, (sum(c) // count(*))::BIGINT AS mean_chars, max(c) AS most_chars, min(t) AS least_tokens, (sum(t) // count(*))::BIGINT AS mean_tokens, max(t) AS most_tokens FROM s GROUP BY 1""",
        "first_modal": rf"SELECT DISTINCT clause_id, loaded_at, nullif(lower(regexp_extract(text, '{MODAL}', 1)), '') AS deontic FROM clauses",
        "stated_values": f"""WITH v AS (SELECT clause_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{VALUE}', 1), lambda x: lower({space})))) AS value FROM clauses)
SELECT value, count(*) AS n_rows, count(DISTINCT clause_id) AS n_clauses FROM v GROUP BY 1""",
        "clause_kinds": rf"""WITH cla AS (SELECT * FROM (SELECT * FROM clauses QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY loaded_at DESC) = 1) WHERE retired_at IS NULL)
SELECT level, CASE WHEN regexp_matches(text, '[:;]\s*$') AND clause_id IN (SELECT parent_id FROM cla WHERE parent_id IS NOT NULL) THEN 'stem'
  WHEN clause_type = 'referential' OR regexp_matches(text, '{REFERENTIAL}') THEN 'referential'
  WHEN clause_type = 'stem' THEN 'substantive' ELSE clause_type END AS kind, count(*) AS n, count(*) FILTER (has_numeric_param) AS n_with_value FROM cla GROUP BY 1, 2""",
        "identifier_harvest": f"SELECT identifier, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, upper(unnest(regexp_extract_all(text, '{IDENTIFIER}'))) AS identifier FROM documents) GROUP BY 1 ORDER BY n DESC, identifier LIMIT 12",
        "corpus_stats": "SELECT status, count(*) AS n_docs, min(length(text)) AS least, (sum(length(text)) // count(text))::BIGINT AS mean, max(length(text)) AS most, count(*) FILTER (coalesce(length(text), 0) = 0) AS n_empty FROM documents GROUP BY 1",
        "html_lines": rf"""SELECT doc_id, md5(list_aggregate(list_filter(list_transform(['Top'] || string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g')), lambda x: x <> ''), 'string_agg', chr(10))) AS text_md5
FROM documents WHERE text IS NOT NULL""",
        "json_answers": r"""WITH b AS (SELECT line_no, regexp_replace(coalesce(payload, ''), '^\s*```(json)?\s*|\s*```\s*$', '', 'g') AS b FROM findings_raw),
s AS (SELECT line_no, b, strpos(b, '[') AS i, length(b) - strpos(reverse(b), ']') + 1 AS k FROM b),
j AS (SELECT line_no, CASE WHEN i > 0 AND strpos(b, ']') > 0 AND k > i THEN substr(b, i, k - i + 1) END AS j FROM s)
SELECT line_no, CASE WHEN j IS NULL THEN 'no JSON array' WHEN NOT json_valid(j) THEN 'malformed JSON' ELSE '' END AS error,
  CASE WHEN j IS NOT NULL AND json_valid(j) THEN len(list_filter(CAST(CASE WHEN json_valid(j) THEN j ELSE '[]' END AS JSON[]), lambda x: json_type(x) = 'OBJECT')) ELSE 0 END AS n_objects FROM j""",
        "catalogue": """SELECT control_id, oscal_id, family, title, is_enhancement, parent_id, withdrawn,
  concat_ws(chr(10), nullif(trim(statement), ''), CASE WHEN len(param_ids) > 0 THEN 'a. See [' || params[-1] || '] and [none].' END) AS statement, coalesce(trim(guidance), '') AS guidance, n_params, array_to_string(params, '|') AS params, upper(array_to_string(related, '|')) AS related
FROM (SELECT * FROM controls QUALIFY row_number() OVER (PARTITION BY control_id ORDER BY loaded_at DESC) = 1) c
WHERE NOT is_enhancement OR EXISTS (SELECT 1 FROM controls p WHERE p.control_id = c.parent_id AND NOT p.is_enhancement)""",
    }
