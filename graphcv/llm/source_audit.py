"""Divergence of sources by their term shares: every pair of sources of a language, and each source's most overused terms.

Counts are sparse: a term that a source does not have has the source's baseline share there. A pair's divergence is the
baselines' over all kept terms, corrected where a term occurs. Long lists are cut by radix: histograms over the bits of the values
find each group's threshold, and equal values there are told apart by the bytes of their terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, small, text_of, written

#: Bytes of terms (letters, lowered, and all of non-ASCII characters), the added count and the scale of shares.
_TERM_BYTES = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
PLUS, SCALE = 5, 1_000_000_000


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term. A task sums up to `most` (source, term) pairs before
    it lets them go, so a frequent term leaves it a few times only."""

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(batches):
        groups, size = {}, 0

        def flush():
            for (lang, source), (times, held) in groups.items():
                names = list(times)
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    text = [t.decode("utf-8", "replace") for t in part]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "source": [source] * len(part), "term": text, "n": [times[t] for t in part], "docs": [held[t] for t in part]}, schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for lang, source, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    found = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()
                    if not found:
                        continue
                    times, held = groups.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(times)
                    own = Counter(found)
                    times.update(own)
                    held.update(own.keys())
                    size += len(times)
                    if size > most:
                        yield from flush()
                        groups, size = {}, 0
        yield from flush()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_of().alias("text"))
    parts = own.mapInArrow(rows, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 terms)), exactly: three steps of long division, so that nothing overflows; 0 without terms.
    The arguments are SQL of longs."""
    whole, rest, out = f"({total} + {PLUS} * {terms})", f"({count} + {PLUS})", "1L"
    for step in (1_000_000, 1_000, 1):
        out += f" + ({rest} * 1000 div {whole}) * {step}L"
        rest = f"({rest} * 1000 % {whole})"
    return F.expr(f"CASE WHEN {terms} > 0 THEN {out} ELSE 0L END")


def top_rows(rows: DataFrame, keys: list[str], value: str, text: str, k: int, bits: int = 30) -> DataFrame:
    """The rows of the k largest values of each group, of equal values those of the least text by UTF-8 bytes; texts differ in a group.

    Radix select: rows are counted by ten bits of the value, the range that holds the k-th is counted by the next ten. If more
    rows have the k-th value than are needed, these are counted by two bytes of the text after another. A step moves 1,024
    counts a group and task at most for values, 65,793 for bytes; no group is sorted. Values are from 0 to 2**bits - 1.
    """
    shift, state = bits, written(rows.select(*keys).distinct().select("*", F.lit(0).cast("long").alias("low"), F.lit(k).cast("long").alias("need")), "radix")

    def narrowed(found: DataFrame, digit: Column, order: Column, low: Column) -> DataFrame:
        sums = found.groupBy(*keys, "low", "need", digit.alias("digit")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        return written(found.select(*keys, low.alias("low"), (F.col("need") - F.col("before")).alias("need"), "n"), "radix")

    while shift > 0:
        after = max(0, shift - 10)
        inside = rows.join(small(state), keys).where(F.shiftright(value, shift) == F.col("low"))
        state, shift = narrowed(inside, F.shiftright(value, after), F.desc("digit"), F.col("digit")), after
    limits = state.select(*keys, F.col("low").alias("limit"), "need", "n")  # groups of fewer than k rows have none
    ties = written(rows.join(small(limits.where("n > need")), keys).where(F.col(value) == F.col("limit")).select(*keys, F.hex(F.col(text).cast("binary")).alias("bytes"), "need"), "ties")
    edge = written(limits.where("n > need").select(*keys, F.lit("").alias("low"), "need"), "edges")
    at = 0
    while not (edge if at == 0 else edge.where("n > need")).isEmpty():
        inside = ties.drop("need").join(small(edge), keys).where(F.substring("bytes", 1, at) == F.col("low"))
        edge, at = narrowed(inside, F.substring("bytes", at + 1, 4), F.asc("digit"), F.concat("low", "digit")), at + 4
    cuts = written(limits.select(*keys, "limit").join(edge.select(*keys, F.col("low").alias("edge")), keys, "left"), "radix-limits")
    met = rows.join(small(cuts), keys, "left")
    tied = F.col("edge").isNull() | (F.substring(F.hex(F.col(text).cast("binary")), 1, at) <= F.col("edge"))
    return met.where(F.col("limit").isNull() | (F.col(value) > F.col("limit")) | ((F.col(value) == F.col("limit")) & tied)).drop("limit", "edge")


def pair_divergence(shares: DataFrame, groups: DataFrame, block_rows: int = 20_000, tile: int = 200) -> DataFrame:
    """lang, source, item, value: sums of |p - q| over all kept terms, for every ordered pair of sources of a language.

    shares: lang, source, term, p of terms that occur; groups: lang, source, base, terms (the share of an absent term, kept terms of the
    language). Terms are dealt to blocks of about `block_rows` rows, sources to tiles of about `tile`; a block and two tiles
    meet in one group, which corrects the baselines' difference for each pair once and gives one row a pair.
    """
    n = shares.count()
    blocks = max(1, -(-n // block_rows))
    widest = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    tiles = -(-widest // tile)
    own = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    with_tiles = lambda df: df.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"a": F.least("own", "x"), "b": F.greatest("own", "x")}).drop("x")
    terms = with_tiles(shares.select("lang", "source", F.xxhash64("term").alias("t"), "p").withColumn("block", F.pmod("t", F.lit(blocks)).cast("int")))
    names = with_tiles(groups.where("terms > 0").select("lang", "source", F.lit(None).cast("long").alias("t"), F.col("base").alias("p"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def correct(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, a, b = key
        heads, rows = pdf[pdf["t"].isna()].sort_values("source"), pdf[pdf["t"].notna()]
        if len(heads) < 2 or not len(rows):
            return pd.DataFrame({"lang": [], "source": [], "item": [], "part": []}, dtype=object)
        names_, base = heads["source"].to_numpy(), heads["p"].to_numpy(dtype=np.int64)
        first, second = np.flatnonzero(heads["own"].to_numpy() == a), np.flatnonzero(heads["own"].to_numpy() == b)
        ids, row = np.unique(rows["t"].to_numpy(dtype=np.int64), return_inverse=True)
        p = np.repeat(base[None], len(ids), 0)
        p[row, np.searchsorted(names_, rows["source"].to_numpy())] = rows["p"].to_numpy(dtype=np.int64)
        out = []
        for i in first:
            others = second[second > i] if a == b else second
            part = np.abs(p[:, others] - p[:, [i]]).sum(0) - len(ids) * np.abs(base[others] - base[i])
            out.append(pd.DataFrame({"lang": lang, "source": names_[i], "item": names_[others], "part": part}))
        return pd.concat(out)

    found = terms.unionByName(names).groupBy("lang", "block", "a", "b").applyInPandas(correct, "lang string, source string, item string, part long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"))
    found = found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part"))
    left, right = groups.select("lang", "source", "base", "terms"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    every = left.join(right, "lang").where("source <> item")  # the result's own rows
    value = F.col("terms") * F.abs(F.col("base") - F.col("other")) + F.coalesce("part", F.lit(0))
    return every.join(found, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank. Part "pair": each other source of the language by divergence; part "term": the k terms whose
    share in the source exceeds the language's most.

    A language keeps the terms of `min_docs` or more of its documents. Null lang, source and text count as ''. Groups without
    terms have baseline shares; a language without kept terms has pairs of value 0 and no terms; a language's only source
    has no pairs. Repeated rows count each; an empty table stays empty; extra columns are ignored. All numbers are whole.
    """
    ship(docs.sparkSession)
    counts = written(term_counts(docs), "term-counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).select("lang", "term", "all"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    sparse = written(counts.join(small(kept), ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept-counts")
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = seen.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    groups = written(groups.withColumn("base", share("0L", "total", "terms")), "groups")
    met = sparse.join(small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"])
    shares = written(met.select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("`all`", "lang_total", "terms").alias("q")), "shares")
    pairs = pair_divergence(shares, groups)
    own = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own.orderBy(F.desc("value"), "item")).alias("rank"))
    over = written(shares.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")), "overused")
    top = top_rows(over, ["lang", "source"], "value", "term", k)
    terms = top.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(own.orderBy(F.desc("value"), "term")).alias("rank"))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * v) AS q
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(u.p - w.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p u ON u.lang = a.lang AND u.source = a.source LEFT JOIN p w ON w.lang = b.lang AND w.source = b.source AND w.term = u.term GROUP BY ALL),
y AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, 'pair' AS part FROM x UNION ALL BY NAME SELECT *, 'term' AS part FROM y),
o AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM z)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
