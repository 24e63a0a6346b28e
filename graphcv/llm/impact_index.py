"""Ranked lexical search over a bit-sliced impact index.

Documents stand in blocks. For each term of a block the index has a bitmap of the documents that hold it, and a bitmap for each
bit of their impacts (the integers that a term adds to a score). A query adds the bitmaps of its terms with carries, so all
documents of a block are scored at once, and finds its best ones from the most significant bitmap of the sums down.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, small, text_of, written

#: What parts terms; of the rest A to Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

#: The terms of the queries thin out the index by so many hashes.
BUCKETS = 1 << 20


def split_terms(text: str | None) -> list[bytes]:
    """Terms in order, with repeats, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda t: t != ""))


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """uint8 bits x ceil(len / 8): bitmap i has bit i of each value."""
    return np.packbits((values[None] >> np.arange(bits)[:, None]) & 1, axis=1, bitorder="little") if bits else np.zeros((0, -(-len(values) // 8)), np.uint8)


def spread(slices: bytes, held: bytes) -> np.ndarray:
    """Bitmaps over the whole block (uint64) from those over the documents that hold the term."""
    present = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))
    own = np.frombuffer(slices, np.uint8).reshape(-1, -(-len(present) // 8))
    full = np.zeros((len(own), len(held) * 8), np.uint8)
    full[:, present] = np.unpackbits(own, axis=1, count=len(present), bitorder="little")
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def add_planes(terms: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of the sums of numbers given by bitmaps: carries are kept beside the sums and rippled through at the end."""
    bits = max((len(t) for t in terms), default=0) + len(terms).bit_length()
    total, carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)
    for t in terms:
        n = len(t)
        both = total[:n] ^ carry[:n]
        most = (total & carry) if n < bits else None
        out = np.zeros_like(carry)
        out[1 : n + 1] = (total[:n] & carry[:n]) | (both & t)
        if most is not None:
            out[n + 1 :] = most[n:-1]
            total[n:] ^= carry[n:]
        total[:n] = both ^ t
        carry = out
    over = np.zeros(words, np.uint64)
    for i in range(bits):
        a, b = total[i], carry[i]
        half = a ^ b
        total[i], over = half ^ over, (a & b) | (half & over)
    return total


def best_places(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of the k largest sums above 0, of equal ones the first places: bitmaps are read from the most significant down."""
    left, sure, need = np.bitwise_or.reduce(sums, axis=0), np.zeros(sums.shape[1], np.uint64), k
    if int(np.bitwise_count(left).sum()) > need:
        for plane in sums[::-1]:
            high = left & plane
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                left = high
            else:
                sure, need, left = sure | high, need - n, left & ~plane
    at = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    places = np.concatenate([at(sure), at(left)[:need]])
    raw = np.ascontiguousarray(sums).view(np.uint8)
    values = np.zeros(len(places), np.int64)
    for i in range(len(raw)):
        values += ((raw[i, places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(np.int64) << i
    return places, values


def postings(docs: DataFrame, wanted: frozenset | None, block_docs: int = 8192, most: int = 4_000_000) -> DataFrame:
    """block, term, places, tfs (packed int32), and a row a block without term: ids, lengths. Blocks are runs of documents of one
    partition, cut at `block_docs` documents or `most` postings, in the order of doc_id. wanted: hashes of terms to keep."""

    def rows(batches):
        from pyspark import TaskContext

        part, known = TaskContext.get().partitionId(), {}
        number, ids, sizes, ts, ds, fs, turn = {}, [], [], array("i"), array("i"), array("i"), 0

        def block():
            order = np.lexsort((np.arange(len(ids)), np.array(ids, dtype=np.int64)))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            t, d, f = (np.frombuffer(x, np.int32) for x in (ts, ds, fs))
            d = place[d]
            o = np.lexsort((d, t))
            t, d, f = t[o], d[o].astype(np.int32), f[o]
            edges = np.flatnonzero(np.diff(t, prepend=-1, append=len(number)))
            names, name = list(number), f"{part}-{turn}"
            yield pa.RecordBatch.from_pydict({"block": [name], "term": pa.array([None], pa.string()), "places": [None], "tfs": [None], "ids": [np.array(ids, np.int64)[order]], "lengths": [np.array(sizes, np.int64)[order]]}, schema)
            for i in range(0, len(edges) - 1, 20_000):
                cut = edges[i : i + 20_001]
                pairs = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_pydict({"block": [name] * len(pairs), "term": [names[t[a]].decode("utf-8", "replace") for a, _ in pairs], "places": [d[a:b].tobytes() for a, b in pairs], "tfs": [f[a:b].tobytes() for a, b in pairs], "ids": [None] * len(pairs), "lengths": [None] * len(pairs)}, schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    found = split_terms(text)
                    if not found:
                        continue
                    here = len(ids)
                    ids.append(doc)
                    sizes.append(len(found))
                    for term, n in Counter(found).items():
                        if wanted is not None:
                            keep = known.get(term)
                            if keep is None:
                                if len(known) > 500_000:
                                    known.clear()
                                keep = known[term] = zlib.crc32(term) % BUCKETS in wanted
                            if not keep:
                                continue
                        ts.append(number.setdefault(term, len(number)))
                        ds.append(here)
                        fs.append(n)
                    if len(ids) >= block_docs or len(ts) >= most:
                        yield from block()
                        number, ids, sizes, ts, ds, fs, turn = {}, [], [], array("i"), array("i"), array("i"), turn + 1
        if ids:
            yield from block()

    schema = pa.schema([("block", pa.string()), ("term", pa.string()), ("places", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    kept = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), "text")
    return kept.mapInArrow(rows, "block string, term string, places binary, tfs binary, ids array<long>, lengths array<long>")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, blocks). index: block, term, held (bitmap of the documents with the term), slices (a bitmap over these for each bit of
    their impacts); blocks: block, ids (a missing doc_id counts as the largest long, and comes last).

    Every document with terms is in one block. terms (term): the index has these alone; 2**20 hashes of them at most go to the
    tasks, and a join decides. Counts over all documents (N, L, df) set the impacts w * ((10**9 tf) div (1000 tf + 20 m)).
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = None
    if terms is not None:
        hashes = terms.select((F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("h")).distinct().toArrow()  # BUCKETS at most
        wanted = frozenset(hashes["h"].to_pylist())
    raw = written(postings(docs, wanted), "postings")
    n_docs, n_terms = raw.where("term is null").agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 1
    df = raw.where("term is not null").groupBy("term").agg(F.sum(F.length("places") / 4).cast("long").alias("df"))
    if terms is not None:
        df = df.join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1)))
    weights = written(df.select("term", weight.cast("long").alias("w")), "term-weights")
    own = raw.where("term is null").select("block", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("tfs"), "lengths", F.lit(None).cast("long").alias("w"))
    met = raw.where("term is not null").drop("ids", "lengths").join(small(weights), "term")
    rows = met.select("block", "term", "places", "tfs", F.lit(None).cast("array<long>").alias("lengths"), "w").unionByName(own)

    def slice_(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["term"].isna()
        lengths = np.asarray(pdf.loc[head, "lengths"].iloc[0], dtype=np.int64)
        m = 50 + (50 * lengths * n_docs) // n_terms
        width, out = -(-len(m) // 64) * 64, []
        for term, places, tfs, w in pdf.loc[~head, ["term", "places", "tfs", "w"]].itertuples(index=False):
            p, tf = np.frombuffer(places, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
            impact = int(w) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[p]))
            held = np.zeros(width, np.uint8)
            held[p] = 1
            out.append((term, np.packbits(held, bitorder="little").tobytes(), planes(impact, int(impact.max()).bit_length()).tobytes()))
        return pd.DataFrame({"block": pdf["block"].iloc[0], "term": [x[0] for x in out], "held": [x[1] for x in out], "slices": [x[2] for x in out]}, dtype=object)

    index = written(rows.groupBy("block").applyInPandas(slice_, "block string, term string, held binary, slices binary"), "impact-index")
    return index, raw.where("term is null").select("block", "ids")


def search(index: DataFrame, blocks: DataFrame, items: DataFrame, k: int = 50, pack: int = 64) -> DataFrame:
    """item (long), doc_id, score, rank: the k best documents with a score above 0 of every item (item, terms).

    Items are dealt to packs of about `pack` by hash. A pack meets a block in one group that has the block's bitmaps of the pack's
    terms alone and gives k rows an item at most; these meet in parts first, then by item.
    """
    packs = max(1, -(-items.count() // pack))
    asked = items.select("item", F.pmod(F.xxhash64("item"), F.lit(packs)).cast("int").alias("pack"), F.explode("terms").alias("term"))
    asked = written(asked.groupBy("term", "pack").agg(F.array_sort(F.collect_list("item")).alias("items")), "asked-terms")
    met = index.join(small(asked), "term")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        wants: dict[int, list[int]] = {}
        for row, items_ in enumerate(pdf["items"]):
            for item in items_:
                wants.setdefault(int(item), []).append(row)
        held, slices, kept, out = pdf["held"].tolist(), pdf["slices"].tolist(), {}, []
        for item, rows in sorted(wants.items()):
            if len(kept) > 400:  # bounds memory alone
                kept.clear()
            for r in rows:
                if r not in kept:
                    kept[r] = spread(slices[r], held[r]) if len(slices[r]) else np.zeros((0, len(held[r]) // 8), np.uint64)
            places, sums = best_places(add_planes([kept[r] for r in rows], len(held[0]) // 8), k)
            out.append(pd.DataFrame({"item": item, "place": places.astype(np.int32), "score": sums}))
        return pd.concat(out).assign(block=pdf["block"].iloc[0])

    found = written(met.groupBy("block", "pack").applyInPandas(score, "block string, item long, place int, score long"), "block-best")
    named = found.join(blocks, "block").select("item", F.get("ids", F.col("place")).alias("id"), "score", F.pmod(F.xxhash64("block"), F.lit(64)).alias("part"))
    order = [F.desc("score"), F.asc("id")]
    some = named.withColumn("n", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("n") <= k)
    top = some.drop("n").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return top.select("item", F.when(F.col("id") < (1 << 63) - 1, F.col("id")).alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each row of `benchmark` (item_id, text), all of `docs` scored.

    Null and empty texts have no terms: such documents are in no list and such items have none. Equal scores stand in the order
    of doc_id, a missing one last; repeated documents are ranked each; repeated items (id and terms) count once. Empty
    tables give an empty one; extra columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), distinct_terms(text_of()).alias("terms")).where(F.size("terms") > 0)
    items = items.select("item_id", F.array_sort("terms").alias("terms")).distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "terms")
    items = written(items, "search-items")
    index, blocks = build_index(docs, items.select(F.explode("terms").alias("term")))
    found = search(index, blocks, items.select("item", "terms"), k)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN d USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
