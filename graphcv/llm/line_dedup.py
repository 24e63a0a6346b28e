"""Cross-site boilerplate removal by the spread of lines over sites, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import small, text_of, written


def line_key(line: Column) -> Column:
    """128 bits of the trimmed, lower-case line."""
    clean = F.lower(F.trim(line))
    return F.struct(F.xxhash64(clean).alias("a"), F.xxhash64(F.lit(1), clean).alias("b"))


def lines(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns and the 128-bit hash (a, b) of each line that is not blank, with its place in the text."""
    cut = docs.select(*columns, F.posexplode(F.split(F.col("text"), "\n")).alias("place", "line"))
    return cut.where(F.trim("line") != "").select(*columns, "place", line_key(F.col("line")).alias("k")).select(*columns, "place", "k.a", "k.b")


def spread_lines(docs: DataFrame, min_sites: int, min_texts: int, lg_k: int = 12, band: float = 0.1, hot: int = 200_000) -> DataFrame:
    """Hashes (a, b) of the lines of `docs` (site, text) that are on `min_sites` or more different sites, and in `min_texts` or more
    different texts, so that a document copied to many sites does not make its own lines boilerplate.

    Lines that stand in too few rows or on one site go first, by cheap counts. The sites and texts of all the others go
    into one HyperLogLog sketch each a line, merged by aggregation. Where an estimate is within `band` of its limit (one
    at least), sites or texts are counted exactly, so the result does not hang on the sketch's error. A line of more than
    `hot` rows is dealt to parts by the rows' column `deal`, an int (without it by the hash of site and text), with a sketch a
    part, so no task holds a whole line; repeats of a (line, site) or (line, text) are dropped in each task before they are counted
    exactly.
    """
    deal = F.col("deal") if "deal" in docs.columns else F.hash("site", "text")
    found = lines(docs.select("site", F.xxhash64("text").alias("t"), deal.alias("deal"), "text"), "site", "t", "deal").drop("place")
    often = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("site").alias("x"), F.max("site").alias("y"))
    often = often.where((F.col("n") >= max(min_sites, min_texts)) & ((F.col("x") < F.col("y")) | F.lit(min_sites <= 1)))
    often = written(often.select("a", "b", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "frequent-lines")

    def met(keys: DataFrame) -> DataFrame:
        """The rows of `found` whose lines are among `keys` (a, b, parts), and the part of its line that a row is dealt to."""
        crowds = small(keys.where("parts > 1").select("a", "b", "parts"))  # each stands for more than `hot` rows
        dealt = found.join(crowds, ["a", "b"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("deal", "parts")).cast("int")).drop("parts", "deal")
        return dealt.join(keys.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["a", "b", "part"])

    sketches = met(often).groupBy("a", "b", "part").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.hll_sketch_agg("t", F.lit(lg_k)).alias("texts"))
    guess = sketches.groupBy("a", "b").agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("sites", "texts")], (F.max("part") + 1).alias("parts"))
    limits = {"sites": min_sites, "texts": min_texts}
    slack = {c: max(1.0, band * n) for c, n in limits.items()}
    able = F.lit(True)
    for c, n in limits.items():
        able = able & (F.col(c) >= n - slack[c])
    guess = written(guess.where(able), "line-spread")
    out = guess
    for c, value in (("sites", "site"), ("texts", "t")):
        near = F.col(c) <= limits[c] + slack[c]
        close = met(guess.where(near)).select("a", "b", value).distinct()
        exact = close.groupBy("a", "b").agg(F.count("*").alias("exact")).where(F.col("exact") >= limits[c])
        out = out.where(~near).unionByName(out.where(near).join(exact.select("a", "b"), ["a", "b"], "left_semi"))
    return out.select("a", "b")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, site: str = "source", min_texts: int | None = None) -> DataFrame:
    """All columns of `docs`, `text` without the lines that are on `min_sites` or more different sites (and in `min_texts` or more
    different texts, as many as sites by default), and n_removed.

    Lines are compared trimmed of spaces and in lower case; blank lines are never removed and the others stay as they
    are, joined by line feeds. A text without such lines, null and empty ones included, is unchanged. A null site is a site
    of its own, "". Repeated rows are treated alike and stay; an empty table stays empty; a column n_removed that `docs`
    already has is replaced. Only hashes of lines are shuffled for the counts; the texts move once, keyed by their own
    hash, to meet the places of their boilerplate lines.
    """
    docs = docs.drop("n_removed")
    own = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), text_of().alias("text"), F.hash(*[c for c, t in docs.dtypes if c != "text" and "map<" not in t]).alias("deal"))
    spread = written(spread_lines(own, min_sites, min_sites if min_texts is None else min_texts), "boilerplate")
    text_key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    places = lines(own.select(*text_key, "text"), "t1", "t2").join(spread, ["a", "b"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(text_of()).alias("t1"), F.xxhash64(F.lit(1), text_of()).alias("t2"))
    found = keyed.join(places, ["t1", "t2"], "left")
    kept = F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda line, i: ~F.array_contains(F.col("places"), i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, site, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM d),
k AS (SELECT *, lower(trim(line, ' ')) AS k FROM l),
b AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10 AND count(DISTINCT text) >= 10),
x AS (SELECT r, count(*) FILTER (WHERE k IN (SELECT k FROM b)) AS n_removed,
             string_agg(line, chr(10) ORDER BY place) FILTER (WHERE k NOT IN (SELECT k FROM b)) AS kept FROM k GROUP BY r)
SELECT d.doc_id, x.n_removed::BIGINT AS n_removed, CASE WHEN x.n_removed = 0 THEN d.text ELSE coalesce(x.kept, '') END AS text
FROM d JOIN x USING (r)
"""
