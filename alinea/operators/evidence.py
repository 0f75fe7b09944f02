"""Proposed relations between a focal and a target text: proposing, checking their evidence, overlaying later rulings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from alinea.functions.keys import norm_key
from alinea.functions.text import MIN_EVIDENCE, collapse, norm
from alinea.plans.skew import skew_join

#: Relations that can be reported, and the names of what a check can find.
RELATIONS = ["equal", "subset_of", "superset_of", "intersects_with"]
ERRORS = ["not_offered", "no_reportable_relation", "bad_confidence", "focal_too_short", "focal_not_verbatim", "target_too_short", "target_not_verbatim"]


def relation(c: Column | str) -> Column:
    """A relation's name as it is compared: lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def judgments(lines: DataFrame) -> DataFrame:
    """One row a finding: ``line_no, finding_no, clause_id, offered`` and its fields; null findings are left out."""
    each = lines.select("line_no", "clause_id", "offered", F.posexplode("findings").alias("at", "f")).where("f is not null")
    return each.select("line_no", (F.col("at") + 1).cast("int").alias("finding_no"), "clause_id", "offered", "f.*")


def verify(rows: DataFrame, focal: DataFrame, target: DataFrame, nfkc: bool = True, hot_rows: int = 250_000) -> DataFrame:
    """``rows`` (see ``judgments``) with ``errors``, the names of what is wrong with each, in the order of ``ERRORS``.

    ``focal`` and ``target``: ``key, text``, unique keys; a missing key has an empty text. A control counts as offered by
    its normalised key. Evidence of fewer than 15 normalised characters is too short, longer one must stand in the
    text; both are normalised (``norm``), the texts once for each key. Null confidence and NaN are out of range.
    """
    plain = not nfkc
    left = rows.withColumn("_f", norm_key("clause_id")).withColumn("_t", norm_key("control_id"))
    left = left.withColumn("_ef", norm("evidence_sama", plain)).withColumn("_et", norm("evidence_nist", plain))
    hay = lambda df, k, h: df.select(F.col("key").alias(k), norm("text", plain).alias(h))
    met = skew_join(left, hay(focal, "_f", "_hf"), ["_f"], "left", None, hot_rows)
    met = skew_join(met, hay(target, "_t", "_ht"), ["_t"], "left", None, hot_rows)
    offered = F.coalesce(F.exists("offered", lambda o: norm_key(o) == F.col("_t")), F.lit(False))
    good = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    found = [~offered, ~F.coalesce(relation("relationship").isin(RELATIONS), F.lit(False)), ~good]
    for e, h in (("_ef", "_hf"), ("_et", "_ht")):
        short = F.length(e) < MIN_EVIDENCE
        found += [short, ~short & ~F.contains(F.coalesce(h, F.lit("")), F.col(e))]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zip(ERRORS, found)]))
    return met.select(*rows.columns, errors.alias("errors"))


def grade(errors: Column, confidence: Column, least: float) -> Column:
    """rejected with errors, else accepted from ``least`` confidence on, else disputed."""
    return F.when(F.size(errors) > 0, "rejected").when(confidence >= least, "accepted").otherwise("disputed")


def in_band(confidence: Column, status: Column, low: float | None = None, below: float | None = None) -> Column:
    """Whether a finding is up for debate: its confidence lies in [low, below), either bound may be open; rejected ones never are.

    A null confidence counts as 0.
    """
    c = F.coalesce(confidence, F.lit(0.0))
    inside = (F.lit(True) if low is None else c >= low) & (F.lit(True) if below is None else c < below)
    return inside & (F.coalesce(status, F.lit("")) != "rejected")


def resolve(ruling: Column, errors: Column, confidence: Column, least: float) -> Column:
    """The status after a ruling: upheld and revised findings pass the gate again, rejected ones are rejected_by_debate, others unresolved."""
    return F.when(ruling.isin("uphold", "revise"), grade(errors, confidence, least)).when(ruling == "reject", "rejected_by_debate").otherwise("unresolved")


def changed(ruling: Column, before: list[Column], after: list[Column]) -> Column:
    """Whether a ruling revises a finding and one of its values differs."""
    differs = F.lit(False)
    for b, a in zip(before, after):
        differs = differs | ~b.eqNullSafe(a)
    return F.coalesce(ruling == "revise", F.lit(False)) & differs


def overlay(rows: DataFrame, rulings: DataFrame, keys: list[str], values: list[str], order: list[str], hot_rows: int = 250_000) -> DataFrame:
    """``rows`` with ``values`` replaced by those of the last ruling for the same ``keys``, and ``ruled``.

    The last by ``order`` of several rulings wins (found by one map-side combined aggregation); its null values leave
    the row's own. Rulings with a null key rule nothing. ``original_`` columns keep the rows' own values.
    """
    last = rulings.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_new"))
    met = skew_join(rows, last, keys, "left", None, hot_rows)
    out = met.select(*[c for c in rows.columns if c not in values], *[F.col(v).alias(f"original_{v}") for v in values], *[F.coalesce(F.col(f"_new.{v}"), F.col(v)).alias(v) for v in values], F.col("_new").isNotNull().alias("ruled"))
    return out


def first_words(c: Column | str, n: int = 14) -> Column:
    """The first ``n`` words of a text, by single blanks."""
    return F.array_join(F.slice(F.split(collapse(c), " "), 1, n), " ")


def mock_proposals(shortlist: DataFrame, focal: DataFrame, target: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: up to three proposals for each query, the third with made-up evidence.

    ``shortlist``: query, control_id, rank; ``focal``: key, text; ``target``: key, text. Targets without text are left
    out, but keep their rank.
    """
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("rank"))
    top = shortlist.where("rank <= 3").join(focal.select(F.col("key").alias("query"), F.col("text").alias("_f")), "query").join(target.select(F.col("key").alias("control_id"), F.col("text").alias("_t")), "control_id")
    made = F.when(F.col("rank") == 3, "a span that stands in none of the texts at all").otherwise(first_words("_t"))
    return top.where("_t <> ''").select("query", "control_id", "rank", pick("subset_of", "intersects_with", "equal").alias("relationship"), pick(0.82, 0.55, 0.71).alias("confidence"), first_words("_f").alias("evidence_sama"), made.alias("evidence_nist"))


def mock_debate(rows: DataFrame) -> DataFrame:
    """A deterministic opponent and arbiter: intersections are objected to and revised to subsets, all else upheld with a little more confidence."""
    objects = F.col("relationship") == "intersects_with"
    return rows.select(
        "*", objects.alias("objection"), F.when(objects, "revise").otherwise("uphold").alias("ruling"),
        F.when(objects, "subset_of").otherwise(F.col("relationship")).alias("new_relationship"),
        F.when(objects, 0.72).otherwise(F.least(F.lit(1.0), F.round(F.col("confidence") + 0.1, 6))).alias("new_confidence"),
    )


def prompts(rows: DataFrame, focal: dict[str, str], target: str = "candidates") -> DataFrame:
    """``rows`` with ``prompt``: the focal fields by their headings, then each candidate (array of control_id, title, statement)."""
    head = [F.concat(F.lit(f"{h}: "), F.col(c)) for c, h in focal.items()]
    each = F.transform(target, lambda x: F.concat_ws("\n", F.concat(F.lit("### "), x["control_id"], F.lit(" "), x["title"]), F.coalesce(F.nullif(x["statement"], F.lit("")), F.lit("(no statement)"))))
    return rows.withColumn("prompt", F.concat_ws("\n", *head, F.array_join(each, "\n"), F.lit("Return a JSON array.")))


def _lines(*parts: Column) -> Column:
    """Parts below each other; null ones are left out."""
    return F.concat_ws("\n", *parts)


def _line(label: str, value: Column, when: Column | None = None) -> Column:
    """A labelled line; null where ``when`` doesn't hold."""
    text = F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("")))
    return text if when is None else F.when(when, text)


def control_block(c: Column) -> Column:
    """A control (struct: control_id, title, family, family_title, is_enhancement, parent_id, statement, params) as a prompt shows it."""
    return F.when(c.isNotNull(), _lines(
        F.concat(F.lit("### "), c["control_id"], F.lit(" - "), F.coalesce(c["title"], F.lit(""))),
        F.concat(F.lit("Family: "), F.coalesce(c["family"], F.lit("")), F.lit(" ("), F.coalesce(c["family_title"], F.lit("")), F.lit(")")),
        _line("Enhancement of ", c["parent_id"], c["is_enhancement"]),
        _line("Statement: ", F.coalesce(F.nullif(c["statement"], F.lit("")), F.lit("(none)"))),
        _line("Open parameters: ", F.array_join(c["params"], "; "), F.size(c["params"]) > 0)))


def clause_block(c: Column) -> Column:
    """A clause (struct: clause_id, subdomain, subdomain_title, principle, text, n_children, full_text, numeric_params) as a prompt shows it."""
    return _lines(
        _line("Identifier: ", c["clause_id"]), F.concat(F.lit("Subdomain: "), F.coalesce(c["subdomain"], F.lit("")), F.lit(" "), F.coalesce(c["subdomain_title"], F.lit(""))),
        _line("Principle of the subdomain: ", c["principle"], c["principle"] != ""), _line("\nText:\n", c["text"]),
        _line("\nWith its items:\n", c["full_text"], c["n_children"] > 0), _line("\nStates a value: ", F.array_join(c["numeric_params"], ", "), F.size(c["numeric_params"]) > 0))


def _quoted(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: “"), F.coalesce(value, F.lit("")), F.lit("”"))


def opponent_prompt(clause: Column, finding: Column, control: Column, others: Column, most: int = 6) -> Column:
    """What an opponent is asked about a finding (struct: control_id, relationship, confidence, evidence_sama, evidence_nist, rationale).

    ``control`` is the finding's own (null if unknown), ``others`` the further ones that were offered, of which the first ``most`` are shown.
    """
    shown = F.slice(F.filter(others, lambda o: o["control_id"] != finding["control_id"]), 1, most)
    brief = F.transform(shown, lambda o: F.concat(F.lit("- "), o["control_id"], F.lit(" - "), F.coalesce(o["title"], F.lit("")), F.lit(": "), F.substring(F.coalesce(o["statement"], F.lit("")), 1, 220)))
    return _lines(
        F.lit("## Clause"), clause_block(clause), F.lit("\n## The proposed mapping"), _line("Control: ", finding["control_id"]), _line("Relationship: ", finding["relationship"]), _line("Confidence: ", finding["confidence"]),
        _quoted("Evidence from the clause", finding["evidence_sama"]), _quoted("Evidence from the control", finding["evidence_nist"]), _line("Stated reason: ", finding["rationale"]),
        F.lit("\n## The control as proposed"), control_block(control), F.when(F.size(shown) > 0, _lines(F.lit("\n## Other controls that were available"), F.array_join(brief, "\n"))), F.lit("\nReturn the JSON object now."))


def arbiter_prompt(clause: Column, finding: Column, objection: Column, control: Column, others: Column, most: int = 5) -> Column:
    """What an arbiter is asked: both positions (objection: struct of objection, grounds, argument, proposed_relationship,
    proposed_control_id, strength) and the controls that may be cited: the finding's, the proposed one, and ``most`` others."""
    instead = F.nullif(F.coalesce(objection["proposed_control_id"], F.lit("")), F.lit(""))
    proposed = F.filter(others, lambda o: (o["control_id"] == instead) & (o["control_id"] != finding["control_id"]))
    rest = F.slice(F.filter(others, lambda o: (o["control_id"] != finding["control_id"]) & ~o["control_id"].eqNullSafe(instead)), 1, most)
    cited = F.transform(F.concat(F.array_compact(F.array(control)), proposed, rest), lambda o: F.concat(control_block(o), F.lit("\n")))
    against = F.when(objection["objection"], _lines(
        _line("Grounds: ", objection["grounds"]), _line("Argument: ", objection["argument"]),
        F.concat(F.lit("Proposed instead: "), F.coalesce(F.nullif(objection["proposed_relationship"], F.lit("")), F.lit("(unchanged)")), F.coalesce(F.concat(F.lit(" on "), instead), F.lit(""))), _line("Stated strength: ", objection["strength"]),
    )).otherwise(_line("No objection raised. Reason given: ", objection["argument"]))
    return _lines(
        F.lit("## Clause"), clause_block(clause), F.lit("\n## Position A: the proposal"), F.concat(_line("Control: ", finding["control_id"]), _line(", relationship: ", finding["relationship"])),
        _quoted("Evidence of the clause", finding["evidence_sama"]), _quoted("Evidence of the control", finding["evidence_nist"]), _line("Reason: ", finding["rationale"]),
        F.lit("\n## Position B: the objection"), against, F.lit("\n## Candidate controls (only these may be cited)"), F.array_join(cited, "\n"), F.lit("Return the JSON object now."))


def estimated_tokens(c: Column | str) -> Column:
    """A rough size of a prompt: a token for four characters."""
    return F.expr(f"length({c}) div 4") if isinstance(c, str) else F.floor(F.length(c) / 4)


def complete(rows: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``key, answer, error`` of a model called once for each prompt; ``client`` makes a model's function on each executor.

    A call that fails gives a null answer and the error's name; it doesn't end the job, so failed keys can be sent again.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt]):
                try:
                    out.append((k, ask(p), ""))
                except Exception as e:
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return rows.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, answer string, error string")


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each combination of ``by`` and their whole percentage (floor) of all rows."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(*by, "n", F.expr("100 * n div total").alias("percent"))  # total: one row


def spread_sample(df: DataFrame, stratum: Column, key: str, n: int, seed: int = 17, least: int = 5) -> DataFrame:
    """About ``n`` rows in proportion to their strata, at least ``least`` of each; in an order of the keys' hash.

    A stratum gets its rounded share (half to even) or ``least``, if that is more, and no more than it has. Its rows
    are cut by the hash's quota through a threshold count, not by sorting a stratum in one task.
    """
    mixed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")
    rows = df.withColumn("_s", stratum).withColumn("_h", mixed).where(F.col("_s").isNotNull())
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    want = sizes.crossJoin(F.broadcast(total)).withColumn("_want", F.greatest(F.lit(least), F.bround(F.lit(n) * F.col("_n") / F.col("_all")).cast("int"))).drop("_all")  # one row
    # A coarse cut first: twice the wanted share of hashes and some more nearly always holds enough, and strata where it
    # doesn't keep all rows; the exact rank is then taken over few rows.
    part = F.col("_h") / float(1 << 60)
    met = rows.join(want, "_s").withColumn("_near", part < 2 * (F.col("_want") + 20) / F.col("_n"))
    enough = met.groupBy("_s").agg((F.count_if("_near") >= F.least(F.first("_want"), F.first("_n"))).alias("_ok"))
    near = met.join(enough, "_s").where(F.col("_near") | ~F.col("_ok"))
    w = Window.partitionBy("_s").orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(w)).where("_r <= _want").drop("_s", "_h", "_n", "_want", "_near", "_ok", "_r")
