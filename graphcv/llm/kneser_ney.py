"""Interpolated modified Kneser-Ney model over five-symbol strings, and perplexities by sharded count joins.

Symbols are the UTF-16 code units of the trusted text, the 4,094 most frequent of them, and one for all others; five of
them are 60 bits of a long and contexts are shifts of it. All trusted text is counted. The distinct strings of each block
of documents (a range of ids) go to shards as packed lists; a shard merges those of a block, joins them with its part of the
model, and each block gets just the strings that it needs, once each, next to its compressed texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import id_values, in_ranges, ship, small, text_of, written

ORDER, BITS, CHUNK, SLICE = 5, 12, 4_000_000, 1_000_000
OTHER = (1 << BITS) - 1
SPREAD = 1_000_003  # strings are dealt to shards by their remainder


def symbol_table(texts: DataFrame) -> np.ndarray:
    """The number of each of the 65,536 code units: 1, 2, ... from the most frequent in `texts` on, OTHER for rare and unknown ones."""
    ship(texts.sparkSession)

    def rows(batches):
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for t in b["text"]:
                n += np.bincount(np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2"), minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"unit": at, "n": n[at]})

    found = texts.select("text").mapInPandas(rows, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    unit, n = found["unit"].to_numpy(), found["n"].to_numpy()
    first = unit[np.lexsort((unit, -n))][: OTHER - 1]
    table = np.full(1 << 16, OTHER, np.uint64)
    table[first] = np.arange(1, len(first) + 1)
    return table


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """The string that ends at each symbol of the text, after marks of the beginning (0), as longs."""
    u = table[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")]
    u = np.concatenate([np.zeros(ORDER - 1, np.uint64), u])
    n = len(u) - ORDER + 1
    g = np.zeros(n, np.uint64)
    for j in range(ORDER):
        g = (g << np.uint64(BITS)) | u[j : n + j]
    return g.view(np.int64)


def _counted(texts, table: np.ndarray):
    """Distinct strings of many texts with their counts, chunk by chunk."""
    held, n = [], 0
    for t in texts:
        g = grams(t, table)
        for i in range(0, len(g), CHUNK):
            held.append(g[i : i + CHUNK])
            n += len(held[-1])
            if n >= CHUNK:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def count_strings(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """gram, n: how often each string occurs in all rows of `texts`."""
    ship(texts.sparkSession)

    def rows(batches):
        for b in batches:
            for g, n in _counted(b["text"], table):
                yield pd.DataFrame({"gram": g, "n": n.astype(np.int64)})

    return texts.select("text").mapInPandas(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    r = table.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(r[k] or 0) for k in range(4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _suffix(order: int) -> Column:
    """The gram without its first symbol, for a gram of `order` symbols."""
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, logp: the natural log of the interpolated probability of the last symbol of each row of `asked` (gram).

    The highest order uses the counts (gram, n), a lower order the number of different symbols before the string.
    """
    tables = {ORDER: written(counts, f"grams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = written(tables[order + 1].select(_suffix(order + 1).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), f"grams-{order}")
    symbols = tables[1].count() + 1
    found = asked.select("gram", F.lit(1.0 / symbols).alias("p"))
    for order in range(1, ORDER + 1):
        table, (d1, d2, d3) = tables[order], _discounts(tables[order])
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        key = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        context = F.shiftrightunsigned(F.col("gram"), BITS)
        contexts = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
        own = table.select(F.col("gram").alias("key"), (n - cut).alias("left"))
        found = found.withColumn("key", key).join(own, "key", "left").withColumn("context", F.shiftrightunsigned("key", BITS)).join(contexts, "context", "left")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("cut") * F.col("p")) / F.col("total"))
        found = found.select("gram", p.alias("p"))
    return found.select("gram", F.log("p").alias("logp"))


def _packed(g: np.ndarray) -> bytes:
    """Ascending strings as compressed differences."""
    return zlib.compress(np.diff(g, prepend=np.int64(0)).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), dtype=np.int64))


def _answers(found: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """block, grams, logs: the strings of each block in `found` (block, grams), once each however many tasks listed them, with their logp in `model`."""
    order = np.argsort(model["gram"].to_numpy())
    known, logp = model["gram"].to_numpy()[order], model["logp"].to_numpy()[order]
    out = []
    for block, lists in found.groupby("block")["grams"]:
        g = np.unique(np.concatenate([_unpacked(x) for x in lists]))
        out.append((block, _packed(g), logp[np.searchsorted(known, g)].tobytes()))
    return pd.DataFrame(out, columns=["block", "grams", "logs"])


def _looked_up(g: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], shards: int) -> np.ndarray:
    """The logp of each string of g in the list (ascending strings, logs) of its shard, slice by slice."""
    out = np.empty(len(g))
    for i in range(0, len(g), SLICE):
        part, own = g[i : i + SLICE], out[i : i + SLICE]
        shard = (part % SPREAD % shards).astype(np.int16)
        order = np.argsort(shard, kind="stable")
        ends = np.cumsum(np.bincount(shard, minlength=shards))
        for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            at = order[ends[k - 1] if k else 0 : ends[k]]
            asked, (known, logp) = part[at], lists.get(k, (np.zeros(0, np.int64), np.zeros(0)))
            place = np.searchsorted(known, asked)
            if not len(known) or (known[np.minimum(place, len(known) - 1)] != asked).any():
                raise RuntimeError("a block met strings that it did not list")
            own[at] = logp[place]
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, chars_a_block: int = 48_000_000, bytes_a_group: int = 32 << 20) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of every row of `docs` under a model of the rows of `trusted` (text).

    Blocks are ranges of ids with about `chars_a_block` symbols; rows without id, and those of one id, are ranges of the
    hash of their text.
    """
    ship(docs.sparkSession)
    table = symbol_table(trusted)
    h = F.xxhash64("text").cast("double")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_of().alias("text"))
    own = own.select("*", *[v.alias(f"v{i}") for i, v in enumerate([*id_values("doc_id"), h])], F.length("text").cast("long").alias("size"))
    chars = own.agg(F.sum("size")).first()[0] or 0
    shards = int(min(4096, max(1, chars // 20_000_000)))
    own = in_ranges(own, [f"v{i}" for i in range(4)], chars_a_block, "size", "range").select("doc_id", "lang", "text", F.xxhash64("range").alias("block"))

    def strings(batches):
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def lists():
            for block, found in held.items():
                g = np.unique(np.concatenate(found))
                shard = g % SPREAD % shards
                order = np.argsort(shard, kind="stable")
                at = np.searchsorted(shard[order], np.arange(shards + 1))
                some = [k for k in range(shards) if at[k] < at[k + 1]]
                yield pd.DataFrame({"block": np.int64(block), "shard": some, "grams": [_packed(g[order[at[k] : at[k + 1]]]) for k in some]})

        for b in batches:
            for block, part in b.groupby("block"):
                for g, _ in _counted(part["text"], table):
                    held.setdefault(block, []).append(g)
                    n += len(g)
                    if n >= 2 * CHUNK:
                        yield from lists()
                        held, n = {}, 0
        yield from lists()

    def packed(batches):
        for b in batches:
            b["text"] = [zlib.compress(t.encode("utf-8", "surrogatepass"), 3) for t in b["text"]]
            yield b[["doc_id", "lang", "text", "block"]]

    lists = written(own.select("block", "text").mapInPandas(strings, "block long, shard long, grams binary"), "block-strings")
    load = lists.agg(F.sum(F.length("grams"))).first()[0] or 0
    deals = int(max(1, -(-load // (shards * bytes_a_group))))  # a shard's lists in groups of bounded size
    lists = lists.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(deals)))

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gram": np.unique(np.concatenate([_unpacked(x) for x in pdf["grams"]]))})

    asked = written(lists.groupBy("shard", "deal").applyInPandas(distinct, "gram long").distinct(), "strings")
    logs = probabilities(count_strings(trusted, table), asked)
    logs = logs.select((F.col("gram") % SPREAD % shards).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), "gram", "logp")

    def answer(key: tuple, found: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        return _answers(found, model).assign(shard=key[0])

    answers = lists.groupBy("shard", "deal").cogroup(logs.groupBy("shard", "deal")).applyInPandas(answer, "block long, grams binary, logs binary, shard long")

    def score(texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        lists = {int(k): (_unpacked(g), np.frombuffer(x)) for k, g, x in zip(model["shard"], model["grams"], model["logs"], strict=True)}
        out, held = [], []

        def flush():
            if not held:
                return
            logp = _looked_up(np.concatenate([g for _, _, g in held]), lists, shards)
            at = 0
            for doc, lang, g in held:
                out.append((doc, lang, len(g), float(np.exp(-logp[at : at + len(g)].mean())) if len(g) else None))
                at += len(g)
            held.clear()

        n = 0
        for doc, lang, t in zip(texts["doc_id"], texts["lang"], texts["text"], strict=True):
            held.append((doc, lang, grams(zlib.decompress(t).decode("utf-8", "surrogatepass"), table)))
            n += len(held[-1][2])
            if n >= SLICE:
                flush()
                n = 0
        flush()
        return pd.DataFrame(out, columns=["doc_id", "lang", "n_tokens", "perplexity"])

    named = own.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no whole numbers beside nulls
    texts = named.mapInPandas(packed, "doc_id string, lang string, text binary, block long")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id string, lang string, n_tokens long, perplexity double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.1) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, keep for every row of `docs`.

    Trusted are the documents whose label `quality` is 1. Those whose crc32(doc_id) mod 5 is not 0 train the model, with
    all their text; the others are held out for the thresholds. The threshold of a language is `slack` times the
    `quantile` of the perplexities of its held-out documents; without such documents, of all held-out ones; without
    any, of the trained ones. A row is kept if its perplexity is at most that. Null and empty texts have no perplexity
    and are not kept; a null language is ""; without trusted text nothing is kept; repeated rows stay; an empty table
    stays empty.
    """
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held")
    ids = written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", held), "trusted-ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    trusted = own.join(small(ids.where("not held")), "doc_id").select("text")
    if trusted.isEmpty():
        trusted = own.join(small(ids), "doc_id").select("text")
    found = written(perplexities(docs, trusted), "perplexities")
    known = found.join(small(ids), "doc_id").where("perplexity is not null")
    limit = lambda value: F.percentile_approx(value, quantile, 10_000) * slack
    held_out = F.when(F.col("held"), F.col("perplexity"))
    by_lang = written(known.groupBy("lang").agg(limit(held_out).alias("own")), "language-limits")
    over_all = known.agg(F.coalesce(limit(held_out), limit(F.col("perplexity"))).alias("common"))
    met = found.join(small(by_lang), "lang", "left").join(F.broadcast(over_all))  # one row
    threshold = F.coalesce("own", "common")
    return met.select("doc_id", "lang", "n_tokens", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
