"""Problem 5: the N best items of every group, by bisecting a cutoff for all groups at once.

An item's place in its group is an order-preserving code: the score's bits as an unsigned integer, then the
identifier's bytes inverted, eight at a time, then its length (so that of two identifiers, one the start of the other,
the shorter goes first). A group's cutoff on the current word of the code is refined by counting the rows at or above
the middle of the interval that it must lie in; rows above the cutoff are in, rows below are out, and where more rows
than are still wanted share the cutoff, they go on to the next word. It ends when each group holds exactly N, or all
it has.

The bisection runs where the rows are first: a chunk of a partition keeps the N best different items of each of its
groups, among which are all that its rows can give to the answer, so no more than N rows for each group and chunk are
shuffled. Groups of which up to ``hot_rows`` rows are left are then brought together by one shuffle and bisected side by
side in vectors, a chunk of many groups at a time. Larger ones never come together: their rows stay spread and each round
is one distributed count, with several cutoffs tried at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alinea.plans.skew import checked_broadcast, hot_keys
from alinea.plans.stage import drop, staged
from alinea.plans.unions import union_all
from alinea.sources.tables import table

#: Rows that a Python task gathers before it bisects the groups in them.
CHUNK_ROWS = 200_000
#: Parts that a distributed round cuts a group's interval into.
WAYS = 64


def score_code(scores: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 counts as 0.0."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def item_code(items: list[bytes], word: int, words: int) -> np.ndarray:
    """Word ``word`` of the inverted identifiers: higher for those that go first. The last word is the inverted length."""
    if word == words - 1:
        plain = np.array([len(x) for x in items], dtype=np.uint64)
    else:
        plain = np.array([int.from_bytes(x[8 * word : 8 * word + 8].ljust(8, b"\0"), "big") for x in items], dtype=np.uint64)
    return ~plain


def bisect_cutoffs(group: np.ndarray, code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``group`` (0..G-1) with ``code``: each group's highest cutoff with ``wanted`` rows at or above it, and how many are above.

    Groups with no more rows than wanted get cutoff 0. Every round halves all open intervals together; rows outside
    of their group's interval are left out of later rounds.
    """
    n_groups = len(wanted)
    low, above = np.zeros(n_groups, np.uint64), np.zeros(n_groups, np.int64)
    total = np.bincount(group, minlength=n_groups)
    open_ = total > wanted
    rows = open_[group]
    g, c = group[rows], code[rows]
    high = np.zeros(n_groups, np.uint64)
    low[open_] = np.iinfo(np.uint64).max
    np.maximum.at(high, g, c)
    np.minimum.at(low, g, c)
    one = np.uint64(1)
    while len(g):
        span = high - low
        middle = low + (span >> one) + (span & one)  # above low as long as the interval is open
        hit = c >= middle[g]
        count = np.bincount(g[hit], minlength=n_groups) + above
        is_open = high > low
        enough = count >= wanted
        exact = is_open & (count == wanted)
        raised, lowered = is_open & enough, is_open & ~enough
        above = np.where(lowered, count, above)
        low = np.where(raised, middle, low)
        high = np.where(lowered, middle - one, np.where(exact, middle, high))
        keep = (high > low)[g]
        inside = keep & (c >= low[g]) & (c <= high[g])
        g, c = g[inside], c[inside]
    picked = code > low[group]
    return low, np.bincount(group[picked], minlength=n_groups)


def select_rows(group: np.ndarray, scores: np.ndarray, items: Callable[[np.ndarray], list[bytes]], n: int) -> np.ndarray:
    """A mask of the rows that belong to the ``n`` best of their group. Rows of a group have different items.

    ``items`` gives the identifiers of rows, for which only those that tie on the score are asked.
    """
    n_groups = int(group.max()) + 1 if len(group) else 0
    taken = np.zeros(len(group), bool)
    rows, wanted = np.arange(len(group)), np.full(n_groups, n, np.int64)
    words, word, code = 0, 0, score_code(scores)
    while len(rows):
        g = group[rows]
        cut, above = bisect_cutoffs(g, code, wanted)
        taken[rows[code > cut[g]]] = True
        wanted = wanted - above
        tied = code == cut[g]
        ties = np.bincount(g[tied], minlength=n_groups)
        all_in = tied & (ties <= wanted)[g]
        taken[rows[all_in]] = True
        rows = rows[tied & ~all_in & (wanted > 0)[g]]
        here = items(rows)
        if not word:
            words = 1 + max((-(-len(x) // 8) for x in here), default=0)
        code = item_code(here, word, words) if len(rows) else code
        word += 1
    return taken


def _best_of(t: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """The ``n`` best rows of each group (columns: group, item, score; items unique in a group), rows of a group together."""
    if t.num_rows:
        keys = t.column(0).combine_chunks().dictionary_encode()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        names, group = t.column(1).combine_chunks(), keys.indices.to_numpy()
        mask = select_rows(group, t.column(2).to_numpy(), lambda rows: [x.encode() for x in names.take(pa.array(rows)).to_pylist()], n)
        at = np.flatnonzero(mask)
        yield from t.take(pa.array(at[np.argsort(group[at], kind="stable")])).combine_chunks().to_batches()


def _in_place(n: int):
    """The bisection over chunks of a partition in whatever order; of an item that comes several times the best score counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            once = t.group_by(["group", "item"]).aggregate([("score", "max")]).select(["group", "item", "score_max"]).rename_columns(t.column_names)
            yield from _best_of(once.cast(t.schema), n)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from done()
                held, rows = [], 0
        if rows:
            yield from done()

    return run


def _local(n: int):
    """The bisection over batches that are sorted by group (columns: group, item, score; items unique in a group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                t = pa.Table.from_batches(held)
                last = t.column(0)[rows - 1].as_py()
                lo, hi = 0, rows - 1  # rows are sorted: the last group, which may go on in the next batch, is found by halving
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if t.column(0)[mid].as_py() == last else (mid + 1, hi)
                yield from _best_of(t.slice(0, lo), n)
                held, rows = t.slice(lo).to_batches(), rows - lo
        if held:
            yield from _best_of(pa.Table.from_batches(held), n)

    return run


def _signed_code(score: Column) -> Column:
    """``score_code`` less 2**63: doubles as signed integers of the same order."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.when(score == 0, F.lit(0.0)).otherwise(score)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _distributed(rows: DataFrame, n: int) -> DataFrame:
    """The bisection of groups too large to come together; ``rows`` has group, item, score, items unique in a group.

    The cutoff of a group is first refined on the score's bits, then on the identifier, a byte at a time. State is one
    row a group, joined to the rows by broadcast only if it is counted small. A round reads only the rows inside the
    intervals that the round before left open.
    """
    rows = staged(rows.withColumn("code", _signed_code(F.col("score"))), "hot-rows")
    state = staged(rows.groupBy("group").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n")), "bounds")
    n_groups = state.count()
    state = state.select("group", "low", "high", F.lit(n).cast("bigint").alias("wanted"), (F.col("n") <= n).alias("whole"))
    settled, active, read = None, rows, []
    while True:
        # low and high are codes of rows; at least `wanted` rows lie at or above low, fewer above high
        open_ = state.where(~F.col("whole") & (F.col("low") < F.col("high")))
        open_ = staged(open_, "bounds")
        closed = state.where(F.col("whole") | (F.col("low") >= F.col("high")))
        settled = closed if settled is None else union_all([settled, closed])
        if open_.isEmpty():
            break
        span = F.try_subtract(F.col("high"), F.col("low")).cast("double")
        place = F.floor(F.try_subtract(F.col("code"), F.col("low")).cast("double") / span * WAYS)
        # An interval over both signs is cut at zero, as its width may be no bigint. The lowest and the highest row never share a part.
        part = F.when((F.col("low") < 0) & (F.col("high") >= 0), (F.col("code") >= 0).cast("bigint")).otherwise(F.least(F.lit(WAYS - 1), place))
        inside = active.join(checked_broadcast(open_, n_groups), "group").where(F.col("code").between(F.col("low"), F.col("high")))
        if active is not rows:
            inside = staged(inside, "inside")
            drop(*read)
            read = [inside]
        parts = inside.groupBy("group", "wanted", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("least"), F.max("code").alias("most"))
        listed = parts.groupBy("group", "wanted").agg(F.reverse(F.array_sort(F.collect_list(F.struct("part", "n", "least", "most")))).alias("parts"))  # at most WAYS entries
        chosen = F.aggregate(
            "parts",
            F.struct(F.lit(0).cast("bigint").alias("above"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")),
            lambda a, p: F.when(a["low"].isNotNull(), a)
            .when(a["above"] + p["n"] >= F.col("wanted"), F.struct(a["above"].alias("above"), p["least"].alias("low"), p["most"].alias("high")))
            .otherwise(F.struct((a["above"] + p["n"]).alias("above"), a["low"].alias("low"), a["high"].alias("high"))),
        )
        state = staged(listed.withColumn("c", chosen).select("group", F.col("c.low").alias("low"), F.col("c.high").alias("high"), (F.col("wanted") - F.col("c.above")).alias("wanted"), F.lit(False).alias("whole")), "bounds")
        active = inside.select("group", "code")
    drop(*read)
    settled = checked_broadcast(staged(settled, "cutoffs"), n_groups)
    met = rows.join(settled, "group")
    out = met.where(F.col("whole") | (F.col("code") > F.col("low"))).select("group", "item", "score")
    return union_all([out, _distributed_ties(staged(met.where(~F.col("whole") & (F.col("code") == F.col("low"))).select("group", "item", "score", "wanted"), "ties"), n_groups)])


def _distributed_ties(ties: DataFrame, n_groups: int) -> DataFrame:
    """The ``wanted`` smallest items in byte order of each group, bisected byte by byte of the identifiers."""
    out, depth = None, 0
    raw = ties.withColumn("raw", F.encode("item", "UTF-8"))
    while True:
        raw = staged(raw, "ties")
        if raw.isEmpty():
            break
        byte = F.conv(F.hex(F.substring("raw", depth + 1, 1)), 16, 10).cast("int")
        code = F.when(F.length("raw") <= depth, F.lit(-1)).otherwise(byte)  # one that ends here goes before those that go on
        counts = raw.groupBy("group", "wanted", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
        listed = counts.groupBy("group", "wanted").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("codes"))  # at most 257 entries
        chosen = F.aggregate(
            "codes",
            F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("int").alias("cut")),
            lambda a, p: F.when(a["cut"].isNotNull(), a).when(a["before"] + p["n"] > F.col("wanted"), F.struct(a["before"].alias("before"), p["code"].alias("cut"))).otherwise(F.struct((a["before"] + p["n"]).alias("before"), a["cut"].alias("cut"))),
        )
        cuts = staged(listed.withColumn("c", chosen).select("group", F.col("c.cut").alias("cut"), (F.col("wanted") - F.col("c.before")).alias("left")), "cutoffs")
        met = raw.join(checked_broadcast(cuts, n_groups), "group").withColumn("code", code)
        inside = met.where(F.col("cut").isNull() | (F.col("code") < F.col("cut"))).select("group", "item", "score")
        out = inside if out is None else union_all([out, inside])
        raw = met.where((F.col("code") == F.col("cut")) & (F.col("left") > 0)).select("group", "item", "score", F.col("left").alias("wanted"), "raw")
        depth += 1
    return out if out is not None else ties.select("group", "item", "score")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, hot_rows: int = 250_000) -> DataFrame:
    """``group, item, score`` of the ``n`` best items of each group, all if there are fewer.

    Rows with a null group or item, or a null or NaN score, don't count; an item counts once a group, with its best
    score; among equal scores the smaller item in byte order goes first. Other columns are left out. ``n`` below 1 and
    empty tables give no rows.
    """
    rows = df.select(F.col(group).alias("group"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("group").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    if n < 1:
        return rows.limit(0).toDF(group, item, score)
    kind = dict(rows.dtypes)["group"]
    shape = f"group {kind}, item string, score double"
    left = staged(rows.mapInArrow(_in_place(n), shape), "best-in-place")
    hot, n_hot = hot_keys(left, ["group"], hot_rows)
    hot = checked_broadcast(hot.select("group"), n_hot)
    best = F.max("score").alias("score")
    # One shuffle by group: the best score of an item is then a matter of one partition.
    cool = left if not n_hot else left.join(hot, "group", "left_anti")
    gathered = [cool.repartition("group").groupBy("group", "item").agg(best)]
    out = []
    if n_hot:
        # Repeated items are combined before the shuffle, which spreads a hot group over all partitions.
        spread = staged(left.join(hot, "group", "left_semi").groupBy("group", "item").agg(best), "hot-items")
        still, n_still = hot_keys(spread, ["group"], hot_rows)
        still = checked_broadcast(still.select("group"), n_still)
        gathered.append(spread.join(still, "group", "left_anti").repartition("group"))
        if n_still:
            out.append(_distributed(spread.join(still, "group", "left_semi"), n))
    out += [x.sortWithinPartitions("group").mapInArrow(_local(n), shape) for x in gathered]
    return union_all(out).toDF(group, item, score)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 best controls of each clause in candidates."""
    return top_n(table(spark, d, "candidates"), "clause_id", "control_id", "score", 5).select("clause_id", "control_id")


P5_SQL = """
WITH best AS (SELECT clause_id, control_id, max(score) AS s FROM candidates
  WHERE clause_id IS NOT NULL AND control_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
SELECT clause_id, control_id FROM best
QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY s DESC, control_id) <= 5
"""


def queries() -> dict:
    return {"p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}
