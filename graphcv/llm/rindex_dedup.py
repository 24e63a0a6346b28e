"""Exact removal of repeated byte strings by run-length (Burrows-Wheeler) indexes over the passages that can repeat.

1. Every window of `length` bytes has an owner: the least hash among its `gram`-byte strings. Equal windows have equal
   owners. Neighbouring windows with one owner form a passage; passages cut the windows of a text into parts.
2. Passages whose owner occurs once cannot hold a repeated window. Equal passages are counted by hash; one that occurs
   twice is repeated as a whole. Only one copy of each different passage of the other owners goes on.
3. Owners are dealt to shards. Each shard builds a run-compressed transform of its passages: only at the ends of its
   runs the match with the neighbouring suffix is measured (the sampled ends); everywhere else the matching statistics
   stream from the last sample, one byte shorter with each step. Windows that match elsewhere are marked. An owner with more
   bytes than a shard is split first: the owner's string grows by half of what is left of a window, to the right where the
   window has room and else to the left, and is the new owner. Equal windows grow alike. Where that leaves large ones they
   grow again, until the owner is the whole window, so a few rounds always end it.
4. The marks return to all copies of the passage and to the texts, which are cut.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, small, text_of, written

_BASE = 0x9E3779B97F4A7C15 | 1
_SPANS = "array<struct<a:long,b:long>>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE & (2**64 - 1), dtype=np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_table: list[np.ndarray] = []


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k-byte string of x."""
    global _table
    n = len(x)
    if not _table or len(_table[0]) < n + 1:
        _table = list(_powers(max(1 << 16, 2 * (n + 1))))
    up, down = _table
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    step, m = 1, v
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = w - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def passages(texts: list[bytes], length: int, gram: int):
    """Of all texts: text number, owner, first byte, end and tie of every passage; tie: the owner may occur in it more than once."""
    data, w = b"".join(texts), length - gram + 1
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram)
    least = sliding_min(h, w)
    inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    some = sizes >= length
    np.add.at(inside, begin[some], 1)
    np.add.at(inside, begin[some] + sizes[some] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.concatenate([[True], least[1:] != least[:-1]])
    change[begin[some]] = True
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(change | ~inside)
    last = np.concatenate([stop, [len(least)]])[np.searchsorted(stop, first, side="right")] - 1
    owner = least[first]
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    tie = np.zeros(len(first), dtype=bool)
    for i in range(0, len(first), 1024):
        k = slice(i, i + 1024)
        x, y = view[first[k]] == owner[k, None], view[last[k]] == owner[k, None]
        tie[k] = (x.sum(1) > 1) | (y.sum(1) > 1) | (first[k] + x.argmax(1) < last[k])
    near = np.searchsorted(begin, first, side="right") - 1
    return near, owner, first - begin[near], last + length - begin[near], tie


def repeated_spans(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each part, the maximal ranges covered by `length`-byte strings that start twice or more in all parts."""
    x = np.zeros(sum(map(len, parts)) + len(parts) + 8, dtype=np.int64)
    begins, at = [], 0
    for p in parts:
        x[at : at + len(p)] = np.frombuffer(p, dtype=np.uint8).astype(np.int64) + 1
        begins.append(at)
        at += len(p) + 1
    n = at
    # suffixes by their first 5 bytes; those that meet a part's end within them are all different, in the parts' order
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(5):
        c = np.where(inside, x[j : n + j], 0)
        key = key * 257 + c
        inside &= c > 0
    bits = max(1, int(n).bit_length())
    place, low = np.arange(n, dtype=np.int64), np.int64((1 << bits) - 1)

    def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions by key, of equals by place, and where the key changes: one plain sort if key and place fit into 63 bits."""
        if int(key.max(initial=0)).bit_length() + bits <= 63:
            packed = np.sort(key << bits | place)
            order, key = packed & low, packed >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        return order, np.concatenate([[True], key[1:] != key[:-1]])

    levels, step = [], 5
    longest = max(map(len, parts), default=0)
    order, new = ordered(key)
    new[1:] |= ~inside[order][1:]
    while True:
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        levels.append((step, rank))
        if new.all() or step > longest:
            break
        key = rank.astype(np.int64) << bits
        key[: n - step] |= rank[step:].astype(np.int64) + 1
        order, new = ordered(key)
        step *= 2
    sa = order
    before = x[sa - 1]  # the transform; the ends of parts are all different
    before = np.where((before == 0) | (sa == 0), -1 - sa, before)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the match of the suffixes at a and b."""
        m = np.zeros(len(a), np.int64)
        for size, rank in reversed(levels):
            i, j = a + m, b + m
            fits = (i < n) & (j < n)
            same = fits & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            m[same] += size
        for _ in range(4):
            c = x[np.minimum(a + m, n)]
            same = (c == x[np.minimum(b + m, n)]) & (c > 0)
            m[same] += 1
        return m

    edge = before[1:] != before[:-1]  # between the end of a run and the start of the next
    heads = np.flatnonzero(edge) + 1
    sampled = common(sa[heads - 1], sa[heads])
    i = np.arange(n)
    marked = np.zeros(n, bool)
    for ends, outermost in ((sa[heads], sa[0]), (sa[heads - 1], sa[-1])):  # matches with the suffix before, with the suffix after
        value = np.full(n, -1, np.int64)
        value[outermost] = 0
        value[ends] = sampled
        last = np.maximum.accumulate(np.where(value >= 0, i, 0))
        marked |= value[last] - (i - last) >= length
    cover = np.zeros(n + length + 1, np.int64)
    starts = np.flatnonzero(marked)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    covered = np.cumsum(cover)[:n] > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    owner = np.searchsorted(np.array(begins), change[::2], side="right") - 1
    for k, a, b in zip(owner, change[::2], change[1::2], strict=True):
        out[k].append((int(a - begins[k]), int(b - begins[k])))
    return out


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _digest(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def grown(x: bytes, owners: np.ndarray, size: int, length: int):
    """The passage x cut by longer owners: first byte, end, new owner and its place in the part. owners: where the owner of `size`
    bytes begins, for each of x's windows."""
    more = (length - size + 1) // 2
    n = len(x) - length + 1
    right = np.arange(n) + length - owners - size >= more
    start = np.where(right, owners, owners - more)
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (right[1:] != right[:-1])]))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        at = int(start[i])
        yield i, j - 1 + length, _digest((b"r" if right[i] else b"l") + x[at : at + size + more]), at - i


def repeated_passages(texts: DataFrame, length: int = 400, gram: int = 128, shard_bytes: int = 1_000_000) -> DataFrame:
    """t1, t2 (hash of a text of `texts`), spans: the byte ranges of the text to remove."""
    spark = texts.sparkSession
    ship(spark)

    def cut(batches):
        for b in batches:
            t1, t2 = b["t1"].to_numpy(), b["t2"].to_numpy()
            some = np.array([t.encode("utf-8", "surrogatepass") for t in b["text"]] + [None], dtype=object)[:-1]
            ends = np.cumsum([len(t) for t in some])
            parts, at = [], 0
            while at < len(some):  # texts of about a quarter of a megabyte together
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 250_000, side="right")))
                near, owner, first, end, tie = passages(list(some[at:to]), length, gram)
                if len(owner):
                    c = [_digest(some[at + k][i:j]) for k, i, j in zip(near.tolist(), first.tolist(), end.tolist(), strict=True)]
                    parts.append(pd.DataFrame({"t1": t1[at:to][near], "t2": t2[at:to][near], "a": first, "b": end, "h": owner.view(np.int64), "c": c, "tie": tie}))
                at = to
            if parts:
                yield pd.concat(parts)

    keyed = texts.select(*text_key(F.col("text")), "text")
    cuts = written(keyed.mapInPandas(cut, "t1 long, t2 long, a long, b long, h long, c long, tie boolean"), "passages")
    live = written(cuts.groupBy("h").agg(F.count("*").alias("n"), F.max("tie").alias("tie")).where("n > 1 or tie").select("h"), "owners")
    cuts = written(cuts.join(small(live), "h"), "live-passages")
    kinds = written(cuts.groupBy("h", "c").agg(F.count("*").alias("n"), F.max("tie").alias("tie"), F.min(F.struct("t1", "t2", "a", "b")).alias("at")), "passage-kinds")
    owners = written(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("tie").alias("tie"), F.sum(F.col("at.b") - F.col("at.a")).alias("size")).where("kinds > 1 or tie"), "index-owners")
    chosen = kinds.join(owners.select("h", "size"), "h").select("h", "c", "size", "at.*")
    held = written(chosen.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "c", "size", "a", "b")).alias("parts")), "passages-to-read")

    def read(batches):
        for b in batches:
            h, c, size, data = [], [], [], []
            for t, parts in zip(b["text"], b["parts"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for p in parts:
                    h.append(p["h"])
                    c.append(p["c"])
                    size.append(p["size"])
                    data.append(raw[p["a"] : p["b"]])
            yield pd.DataFrame({"h": h, "c": c, "size": size, "data": data})

    met = keyed.join(held, ["t1", "t2"]).select("text", "parts")
    found = written(met.mapInPandas(read, "h long, c long, size long, data binary").dropDuplicates(["h", "c"]), "passage-texts")
    marks = _indexed(found.where(F.col("size") <= shard_bytes), length, shard_bytes)
    large = found.where(F.col("size") > shard_bytes)
    if not large.isEmpty():
        marks = marks.unionByName(_by_grown_owners(large, length, gram, shard_bytes))
    marks = written(marks, "passage-marks")
    once = marks.join(kinds.where("n = 1").select("h", "c", "at"), ["h", "c"]).select("at", F.explode("spans").alias("s"))
    within = once.select("at.t1", "at.t2", (F.col("at.a") + F.col("s.a")).alias("a"), (F.col("at.a") + F.col("s.b")).alias("b"))
    spans = _copied(cuts, kinds).unionByName(within)
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _copied(cuts: DataFrame, kinds: DataFrame, many: int = 500) -> DataFrame:
    """t1, t2, a, b of the passages that have copies. Those of over `many` copies are few kinds, met without dealing their rows by kind."""
    crowds = kinds.where(F.col("n") > many).select("h", "c", F.lit(True).alias("crowd"))
    met = cuts.join(small(crowds), ["h", "c"], "left")
    rest = met.where("crowd is null").join(kinds.where(F.col("n").between(2, many)).select("h", "c"), ["h", "c"], "left_semi")
    return met.where("crowd").unionByName(rest).select("t1", "t2", "a", "b")


def _indexed(found: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """h, c, spans: the repeated ranges of passages (h, c, data) among those of one owner h; shards of owners are indexed together."""

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = repeated_spans(list(pdf["data"]), length)
        return pd.DataFrame({"h": pdf["h"], "c": pdf["c"], "spans": [[{"a": a, "b": b} for a, b in s] for s in spans]})

    total = found.agg(F.sum(F.length("data"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("h"), F.lit(max(1, int(total // shard_bytes)))).alias("shard")
    return found.select(shard, "h", "c", "data").groupBy("shard").applyInPandas(index, f"h long, c long, spans {_SPANS}").where(F.size("spans") > 0)


def _by_grown_owners(found: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """The marks of the passages of owners with more bytes than a shard: owners grow until their parts fit (see `grown`).

    Parts keep the passage they come from (h0, c0) and where they begin there. Only one of equal parts goes on.
    """

    def rows(batches, size):
        for b in batches:
            out = []
            for h0, c0, off, h, p, x in zip(b["h0"], b["c0"], b["off"], b["h"], b["p"], b["data"], strict=True):
                n = len(x) - length + 1
                owners = np.full(n, p, np.int64)
                if p < 0:  # the first owner, wherever it stands; a window's is the first in it
                    places = np.flatnonzero(gram_hashes(np.frombuffer(x, dtype=np.uint8), gram).view(np.int64) == h)
                    owners = places[np.searchsorted(places, np.arange(n))]
                out += [(h0, c0, off + i, key, _digest(x[i:j]), at, x[i:j]) for i, j, key, at in grown(x, owners, size, length)]
            yield pd.DataFrame(out, columns=["h0", "c0", "off", "h", "c", "p", "data"])

    size, marks = gram, None
    todo = found.select(F.col("h").alias("h0"), F.col("c").alias("c0"), F.lit(0).cast("long").alias("off"), "h", F.lit(-1).cast("long").alias("p"), "data")
    while True:
        parts = written(todo.mapInPandas(partial(rows, size=size), "h0 long, c0 long, off long, h long, c long, p long, data binary"), "grown-parts")
        size += (length - size + 1) // 2
        kinds = written(parts.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("h0", "c0", "off")).alias("at"), F.first("p").alias("p"), F.first("data").alias("data")), "grown-kinds")
        owners = written(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.length("data")).alias("size")).where("kinds > 1"), "grown-owners")
        fits = (F.col("size") <= shard_bytes) | F.lit(size >= length)
        whole = parts.join(kinds.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("h0", "c0", F.col("off").alias("a"), (F.col("off") + F.length("data")).alias("b"))
        inside = _indexed(kinds.join(small(owners.where(fits).select("h")), "h"), length, shard_bytes).join(kinds.where("n = 1").select("h", "c", "at"), ["h", "c"]).select("at", F.explode("spans").alias("s"))
        found = whole.unionByName(inside.select("at.h0", "at.c0", (F.col("at.off") + F.col("s.a")).alias("a"), (F.col("at.off") + F.col("s.b")).alias("b")))
        marks = found if marks is None else marks.unionByName(found)
        large = owners.where(~fits).select("h")
        if large.isEmpty():
            break
        todo = kinds.join(small(large), "h").select("at.*", "h", "p", "data")
    return marks.groupBy(F.col("h0").alias("h"), F.col("c0").alias("c")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, text: bool = True, **options) -> DataFrame:
    """Remove each byte covered by a `length`-byte string of the UTF-8 text that also starts anywhere else in `docs`.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with `text`, kept (binary).
    Overlaps count, matches never cross documents, all strings are judged on the input. Null and empty texts, and those
    shorter than `length`, lose nothing. Repeated rows repeat each other, so long ones lose all; every copy is cut alike.
    Extra columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    spans = repeated_passages(own.select("text"), length, **options)
    keyed = own.select("doc_id", "text", *text_key(F.col("text")))

    def cut(batches):
        for b in batches:
            rows = []
            for i, t, spans in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                gone = _union((s["a"], s["b"]) for s in spans) if spans is not None else []
                kept, at = [], 0
                for x, y in gone:
                    kept.append(raw[at:x])
                    at = y
                left = b"".join([*kept, raw[at:]])
                rows.append((i, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *([left] if text else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])])

    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else "")
    return keyed.join(spans, ["t1", "t2"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans").mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
