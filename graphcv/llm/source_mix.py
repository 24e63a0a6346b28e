"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sizes are words. Sources share a budget by their weights, none above `most` times its own size. Inside a source a document is
wanted `min(most, c * b)` times, b the number of binary digits of its size and c such that the expected words are the
source's target. The whole part of that is certain; the rest is the inclusion probability p of one copy more. Documents are
ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and the first ones are taken up to the words
that are left of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcv.llm.shared import small, text_of, written

#: Words of a text, and the weights of the sources in their order, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

#: A rank has 52 bits, the place of a row 63; both are searched 13 bits at a time.
STEPS = [("rank", 39), ("rank", 26), ("rank", 13), ("rank", 0), ("place", 52), ("place", 39), ("place", 26), ("place", 13), ("place", 0)]


def measured(docs: DataFrame, source: str, seed: int) -> DataFrame:
    """place, doc_id, s, size, u: a number a row, the source as a text that sorts by code point with null last, words, and 52
    random bits that hang on seed, doc_id and text alone."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of().cast("binary"))).cast("binary"))
    name = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    return docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), name.alias("s"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.conv(F.substring(draw, 1, 13), 16, 10).cast("long").alias("u"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """`sources` (s, source_size) with weight and target: `share` times all words, by weights in the order of s, repeating. A target
    stops at `most` times its source's size; the excess is shared again by weight until none is above.

    Places in the order come from ranges of s, whose counts are one row a range; each round of sharing gathers one row.
    """
    cut = written(sources.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "sources")
    starts = cut.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    turn = F.pmod(F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1, F.lit(len(weights))).cast("int")
    known = written(cut.join(small(written(starts, "starts")), "part").select("s", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "weights")
    total, mass = known.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = share * (total or 0) / (mass or 1.0), 0
    while True:
        over = level * F.col("weight") > most * F.col("source_size")
        n, full, rest = known.agg(F.count_if(over), F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (share * (total or 0) - (full or 0)) / rest, n
    return known.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight")))


def digits(size: Column) -> Column:
    """Binary digits of a size; none for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def inclusion(classes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """s, b, whole, p, rest: certain copies of the documents of `b` digits of a source, the probability of one more, and the words of
    the source's target that certain copies leave. classes: s, b, words; at most 64 rows a source."""
    met = classes.where("b > 0").join(targets.select("s", "target"), "s")
    down = Window.partitionBy("s").orderBy(F.desc("b"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("b") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    met = met.withColumn("c", (F.col("target") - most * above) / below)
    fits = F.max(F.when(F.col("c") * F.col("b") <= most, F.struct("b", "c"))).over(Window.partitionBy("s"))["c"]
    met = met.withColumn("wanted", F.coalesce(F.least(F.lit(float(most)), fits * F.col("b")), F.lit(float(most)))).withColumn("whole", F.floor("wanted").cast("long"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("s"))
    return met.select("s", "b", "whole", (F.col("wanted") - F.col("whole")).alias("p"), rest.alias("rest"))


def pareto_rank(u: Column, p: Column) -> Column:
    """52 bits of q / (1 + q), q the random odds over the inclusion odds."""
    x = (u + 0.5) / F.lit(float(1 << 52))
    q = (x / (1 - x)) * ((1 - p) / p)
    return F.floor(q / (1 + q) * F.lit(float(1 << 52))).cast("long")


def boundaries(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """s, cut_rank, cut_place, lack: for each source the document at which the words of its documents, in the order of (rank, place), pass
    `rest`, and the words that lack before it. Sources whose documents never pass it have no row.

    A radix search: words are summed by 13 bits of the key, the range that holds the boundary is searched by the next 13 bits,
    until each range holds one document. A step shuffles 8,192 sums a source and task at most; no source is sorted.
    """
    state = written(rests.select("s", "rest", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("known"), F.lit(0).cast("long").alias("base"), F.lit(2).cast("long").alias("n")), "cuts")
    was, shift = "rank", 52

    def inside():
        """The rows of the range that each source's search has come to."""
        range_ = F.shiftright(was, shift) == F.col("low")
        return rows.join(small(state), "s").where(range_ if was == "rank" else range_ & (F.col("rank") == F.col("known")))

    for column, after in STEPS:
        if column != was:  # whole ranks are equal: their rows are searched by place
            state, was, shift = state.withColumns({"known": F.col("low"), "low": F.lit(0).cast("long")}), column, 63
        sums = inside().groupBy("s", "rest", "known", "base", F.shiftright(column, after).alias("low")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        state = written(found.select("s", "rest", "low", "known", F.col("before").alias("base"), "n"), "cuts")
        shift = after
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    return inside().select("s", F.col("rank").alias("cut_rank"), F.col("place").alias("cut_place"), (F.col("rest") - F.col("base")).alias("lack"))


def mix_sources(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: how many words (and whole copies) of each document the mix takes.

    Taken words of a source end within the size of its boundary document of the target, and nearer where another document that
    is not taken fills the gap better: of these the one whose size is nearest to what lacks is taken. No document is taken
    more than `most` times. Null and empty texts have the size 0 and are never taken; a null source is a source of its own,
    the last. Rows with equal ids are different documents; equal rows are too, and which of them are taken makes no
    difference. Equal ranks are decided by the row's place. An empty table stays empty; extra columns are ignored.
    """
    rows = written(measured(docs, source, seed).withColumn("b", digits(F.col("size"))), "sizes")
    classes = written(rows.groupBy("s", "b").agg(F.sum("size").alias("words")), "size-classes")
    targets = written(source_targets(classes.groupBy("s").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    chances = written(inclusion(classes, targets, most), "chances")
    met = rows.join(small(chances), ["s", "b"], "left")
    drawn = met.where("p > 0").select("s", "size", "place", pareto_rank(F.col("u"), F.col("p")).alias("rank"))
    cuts = written(boundaries(drawn, chances.groupBy("s").agg(F.max("rest").alias("rest"))), "boundaries")
    order = F.struct("rank", "place")
    left = drawn.join(small(cuts), "s").where(order >= F.struct(F.col("cut_rank").alias("rank"), F.col("cut_place").alias("place")))
    gap = F.abs(F.col("size") - F.col("lack"))
    fills = written(left.where(gap < F.col("lack")).groupBy("s").agg(F.min(F.struct(gap.alias("gap"), "rank", "place")).alias("best")).select("s", F.col("best.place").alias("fill")), "fills")
    marks = small(written(targets.select("s", "source_size", "target").join(cuts, "s", "left").join(fills, "s", "left"), "marks"))
    all_ = rows.join(small(chances), ["s", "b"], "left").join(marks, "s")
    ranked = all_.withColumn("rank", F.when(F.col("p") > 0, pareto_rank(F.col("u"), F.when(F.col("p") > 0, F.col("p")))))
    first = F.col("cut_rank").isNull() | (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("place") < F.col("cut_place")))
    more = F.when(F.col("p") > 0, (first | F.coalesce(F.col("place") == F.col("fill"), F.lit(False))).cast("long")).otherwise(0)
    copies = F.coalesce(F.col("whole") + more, F.lit(0)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), F.when(F.col("s") != "1", F.substring("s", 2, 1 << 30)).alias("source"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u FROM documents),
r AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS b FROM d),
k AS (SELECT s, b, sum(size)::BIGINT AS words FROM r GROUP BY ALL),
w AS (SELECT s, sum(words)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS weight FROM k GROUP BY s),
h AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / sum(weight) OVER (ORDER BY 2 * source_size / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT s, source_size, least((2 * source_size)::DOUBLE, (SELECT min_by(level, 2 * source_size / weight) FROM h WHERE level * weight <= 2 * source_size) * weight) AS target FROM h),
c AS (SELECT k.*, target, (target - 2 * coalesce(sum(words) OVER (PARTITION BY s ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(b * words) OVER (PARTITION BY s ORDER BY b DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM k JOIN t USING (s) WHERE b > 0),
f AS (SELECT s, max_by(c, b) AS fit FROM c WHERE c * b <= 2 GROUP BY s),
g AS (SELECT c.*, coalesce(least(2.0::DOUBLE, fit * b), 2.0::DOUBLE) AS wanted, floor(wanted)::BIGINT AS whole, wanted - whole AS p FROM c LEFT JOIN f USING (s)),
e AS (SELECT *, target - (sum(whole * words) OVER (PARTITION BY s))::DOUBLE AS rest FROM g),
q AS (SELECT r.*, whole, p, rest, (u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x, (x / (1 - x)) * ((1 - p) / p) AS odds, floor(odds / (1 + odds) * 4503599627370496.0::DOUBLE)::BIGINT AS rank
      FROM r JOIN e USING (s, b) WHERE p > 0),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q),
b AS (SELECT s, rank AS cut, doc_id AS cut_id, rest - before AS lack FROM o WHERE before <= rest AND before + size > rest),
z AS (SELECT o.*, lack, b.s IS NULL OR (rank, o.doc_id) < (cut, cut_id) AS first FROM o LEFT JOIN b USING (s)),
y AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY first, abs(size - lack), rank) = 1 AND NOT first AND abs(size - lack) < lack AS fill FROM z)
SELECT r.doc_id, r.size, t.source_size, t.target, (r.size * (coalesce(e.whole, 0) + CASE WHEN coalesce(y.first OR y.fill, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN t USING (s) LEFT JOIN e ON r.s = e.s AND r.b = e.b LEFT JOIN y ON y.doc_id = r.doc_id AND y.s = r.s
"""
