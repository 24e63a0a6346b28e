"""SimHash fingerprints and a search by permuted block tables, with DataFrame functions only.

A term is a run of three words; it votes once for each time it occurs, so its weight is its frequency. Each of the 128
bits of its hash votes for or against that bit of the fingerprint; a bit is 1 where the votes for it are the majority.
Votes are counted two bits to a sum, in the halves of a long.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcv.llm.shared import id_values, in_ranges, let, small, text_of, written

BITS = 128
_LANES = 0x0000000100000001


def term_hashes(text: Column) -> Column:
    """Hashes of the runs of three words (shorter ones at the end), in order, with repeats; none for a blank text."""
    hashes = let(F.split(F.trim(text), r"\s+"), lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    return F.when(F.trim(text) == "", F.array().cast("array<bigint>")).otherwise(hashes)


def _votes(h: Column, name: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"{name}{i}") for i in range(32)]


def _word(name: str, n: Column) -> Column:
    """64 bits from 32 sums of two lanes; n: number of votes."""
    bits = []
    for i in range(32):
        sums = F.coalesce(F.col(f"{name}{i}"), F.lit(0).cast("long"))
        for lane, shift in ((sums.bitwiseAND(F.lit(0xFFFFFFFF)), i), (F.shiftrightunsigned(sums, 32), i + 32)):
            bits.append(F.shiftleft((lane * 2 > n).cast("long"), shift))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each row of `rows` (whose `keys` are unique): the keys, hi and lo, the two halves of the fingerprint.

    Blank texts have no terms and the fingerprint 0. If `rows` is partitioned by some of the keys, nothing is shuffled.
    """
    terms = rows.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("h"))
    votes = terms.groupBy(*keys).agg(F.count("h").alias("n"), *_votes(F.col("h"), "a"), *_votes(F.xxhash64("h"), "b"))
    return votes.select(*keys, F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(_word("a", F.col("n"))).alias("hi"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(_word("b", F.col("n"))).alias("lo"))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(float(BITS))


def as_hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def near_fingerprints(prints: DataFrame, radius: int = 6, blocks: int | None = None, salt_rows: int = 2_000) -> DataFrame:
    """All pairs of different fingerprints of `prints` (hi, lo) at most `radius` bits apart: hi, lo, hi2, lo2, apart, each pair once.

    The bits are cut into `blocks` (radius + 2 by default) of nearly equal width. Two such fingerprints agree in blocks -
    radius blocks at least, so one table for each choice of that many blocks holds them under one key. Equal fingerprints
    are joined into one row first, so groups of copies make no pairs. Keys of more than `salt_rows` fingerprints are
    dealt to tiles: a fingerprint meets the others of its key in parts, so no task holds a whole key.
    """
    blocks = blocks or radius + 2
    if not radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    distinct = prints.select("hi", "lo").distinct()
    edge = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(a: int, b: int) -> Column:
        """Bits a to b of the fingerprint, at most 64."""
        halves = []
        for word, low, high in ((F.col("hi"), max(a, 0), min(b, 64)), (F.col("lo"), max(a - 64, 0), min(b - 64, 64))):
            if low < high:
                mask = (1 << (high - low)) - 1 if high - low < 64 else -1
                halves.append(F.shiftrightunsigned(word, low).bitwiseAND(F.lit(mask).cast("long")))
        return halves[0] if len(halves) == 1 else F.xxhash64(*halves)

    part = [bits(edge[i], edge[i + 1]) for i in range(blocks)]
    chosen = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in c]) for k, c in enumerate(chosen)])
    tables = distinct.select("hi", "lo", F.explode(keys).alias("key"))
    crowds = written(tables.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > salt_rows).select("key", F.ceil(F.col("n") / salt_rows).cast("int").alias("parts")), "crowded-keys")
    dealt = tables.join(small(crowds), "key", "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("hi", "lo"), F.col("parts"))).cast("int"))
    left = dealt.select("hi", "lo", "key", "own", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other"))
    right = dealt.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "key", F.col("own").alias("other"))
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2")))
    less = (F.col("hi") < F.col("hi2")) | ((F.col("hi") == F.col("hi2")) & (F.col("lo") < F.col("lo2")))
    pairs = left.join(right.hint("shuffle_merge"), ["key", "other"]).where(less & (apart <= radius))
    return pairs.groupBy("hi", "lo", "hi2", "lo2").agg(F.first(apart).cast("int").alias("apart"))


def followed(docs: DataFrame, rows_a_block: int = 2_000) -> DataFrame:
    """`docs` (doc_id, text) with the text of the next document in descending order of doc_id; after the last comes the first.

    Returns block, place, doc_id, text, next_text and extra, partitioned by block. Blocks are ranges of doc_id of about
    `rows_a_block` rows (see `in_ranges`; any 64-bit ids will do); the first row of the block that follows is added to
    each block as an extra row (extra = 1), so one window a block finds all followers. Null ids come last; rows with
    equal ids stand in order of the hash of their text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    h = F.xxhash64("text")
    values = [v.alias(f"v{i}") for i, v in enumerate([*id_values("doc_id", True), h.cast("double")])]
    own = in_ranges(docs.select("doc_id", "text", h.alias("h"), *values), [f"v{i}" for i in range(4)], rows_a_block)
    # the first row of each block, and the block before it: one row a block
    first = own.groupBy("block").agg(F.min(F.struct("v0", "v1", "v2", "h", "doc_id")).alias("first"))
    turn = Window.orderBy("block")
    heads = first.select("first.doc_id", "first.h", F.coalesce(F.lag("block").over(turn), F.max("block").over(Window.partitionBy())).alias("target"))
    heads = written(heads.select(F.col("doc_id").alias("head"), F.col("h").alias("head_h"), "target"), "heads")
    extra = docs.join(small(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (h == F.col("head_h"))).select(F.col("target").alias("block"), "doc_id", "text", F.col("head_h").alias("h"), F.lit(1).alias("extra"))
    rows = own.select("block", "doc_id", "text", "h", F.lit(0).alias("extra")).unionByName(extra)
    w = Window.partitionBy("block").orderBy("extra", F.desc_nulls_last("doc_id"), "h")
    return rows.select("block", F.row_number().over(w).alias("place"), "doc_id", "text", F.lead("text").over(w).alias("next_text"), "extra")


def fingerprint_documents(docs: DataFrame, radius: int = 6) -> DataFrame:
    """Fingerprints of whole texts and of edited texts, and near fingerprints.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document's (see `followed`). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex),
    near_edited, near_next (share of equal bits) and near_docs: the number of other rows whose fingerprint is at most
    `radius` bits away. Null and empty texts have the fingerprint 0; equal texts have equal fingerprints; repeated rows
    give repeated rows; an empty table gives an empty one; extra columns are ignored.
    """
    rows = followed(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.when(cut > 0, F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")).otherwise(""))
    rows = rows.select("block", "place", "doc_id", "extra", n.cast("long").alias("n_chars"), "text", F.when(F.col("extra") == 0, edited).alias("edited"))
    both = rows.select("block", "place", "doc_id", "extra", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.when(F.col("extra") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"))))).alias("x"))
    both = both.select("block", "place", "doc_id", "extra", "n_chars", "edited_sha256", "x.kind", "x.t")
    keys = ["block", "place", "kind", "doc_id", "extra", "n_chars", "edited_sha256"]
    prints = fingerprints(both, keys, "t")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = prints.groupBy("block", "place", "doc_id", "extra", "n_chars", "edited_sha256").agg(pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"), pick(1, "hi").alias("edited_hi"), pick(1, "lo").alias("edited_lo"))
    w = Window.partitionBy("block").orderBy("place")
    wide = wide.withColumns({"next_hi": F.lead("hi").over(w), "next_lo": F.lead("lo").over(w)}).where("extra = 0")
    prints = written(wide.drop("block", "place", "extra"), "prints")
    copies = prints.groupBy("hi", "lo").agg(F.count("*").alias("copies"))
    pairs = near_fingerprints(prints, radius).select("hi", "lo", "hi2", "lo2")
    both_ways = pairs.unionByName(pairs.select(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2")))
    others = both_ways.join(copies.withColumnsRenamed({"hi": "hi2", "lo": "lo2", "copies": "others"}), ["hi2", "lo2"]).groupBy("hi", "lo").agg(F.sum("others").alias("others"))
    near = copies.join(others, ["hi", "lo"], "left").select("hi", "lo", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("near_docs"))
    c = F.col
    return prints.join(near, ["hi", "lo"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("hi", "lo").alias("fingerprint"),
        as_hex("edited_hi", "edited_lo").alias("edited_fingerprint"),
        likeness((c("hi"), c("lo")), (c("edited_hi"), c("edited_lo"))).alias("near_edited"),
        likeness((c("hi"), c("lo")), (c("next_hi"), c("next_lo"))).alias("near_next"),
        "near_docs",
    )
