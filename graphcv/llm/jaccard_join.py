"""Exact similarity join of shingle sets by token-combination prefixes.

Tokens are hashes of word shingles. Equal sets are one class. Tokens are ordered from rare to frequent by a table of
2**20 counts that covers all documents; the order only has to be the same everywhere, so collisions in it cost time,
not links. Two classes of sizes m <= n can only be linked if m >= t n and if their prefixes share tokens: with the
prefixes made longer by one token they share two at least. One rare token shared is enough to index; of frequent
tokens two must be shared, so pairs of them are indexed. Each key tells how many tokens two sets can still share if it
is the first that they share; where that is too few, the pair is none.

Candidates are made in two steps, so that a group of near copies never becomes all its pairs. First each class meets
only one leader under each of its keys, drawn by hash for each key. The links found there join classes into groups. Then classes of different
groups meet under the keys where several groups stand. A pair whose parity sketches differ in more bits than the sets
may differ in tokens is no link; the others are verified on whole sets. Links inside groups are counted in tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.llm.components import connected_components
from graphcv.llm.shared import ship, small, text_of, written

SLOTS = 1 << 20
WORDS = 16  # longs of a parity sketch
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Memory(dict):
    """Hashes of words, remembered for a task; emptied when full, some 15 MB."""

    def __missing__(self, word):
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Seen(set):
    """Classes that a task has met lately, some 10 MB."""

    def first(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) >= 100_000:
            self.clear()
        self.add(key)
        return True


_hashes = _Memory()


def _slices(batches, rows: int = 1_000):
    """Arrow batches in slices, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a shorter text is one run, one without words has none.

    Words are split at the bytes 0x20 and 0x09-0x0D, A-Z in lower case: what lower() and split() do to bytes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : n - k + 1 + j]
        out ^= out >> np.uint64(32)
        out *= _MIX
    return np.unique(out).view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    """The class of a set: a hash of its sorted tokens."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "little", signed=True)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """1,024 parities of the tokens' numbers by place: two sets differ in as many tokens, at least, as their sketches in bits."""
    at = (hashes.view(np.uint64) >> np.uint64(44)).astype(np.int64) & (64 * WORDS - 1)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def prefix_keys(hashes: np.ndarray, counts: np.ndarray, percent: int, frequent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set's prefix, longer by one token: rare tokens alone, frequent ones in pairs.

    With each key its room, the number of tokens that can be shared if it is the first that is, and the count of its
    rarest token. A set that may share one token only also stands under each frequent token.
    """
    n = len(hashes)
    need = -(-percent * n // 100)  # tokens shared with any linked set that is not smaller, at least
    c = counts[hashes & (SLOTS - 1)]
    order = np.lexsort((hashes, c))[: min(n - need + 2, n)]
    p, c = hashes[order], c[order]
    rare = c < frequent
    alone = np.flatnonzero(rare | (need < 2))
    often = np.flatnonzero(~rare)
    i, j = np.triu_indices(len(often), 1)
    i, j = often[i], often[j]
    with np.errstate(over="ignore"):
        both = (p[i] * np.int64(-7046029254386353131)) ^ (p[j] * np.int64(-4417276706812531889))
    return np.concatenate([p[alone], both]), np.concatenate([n - alone, n - j + 1]), np.concatenate([c[alone], c[i]])


def shingle_classes(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """A row for each row of `docs`: doc_id, t1, t2 (hash of the text), sig, n, s0-s15 (sketch); and the counts of the tokens of all
    classes by slot. One pass over the texts; copies that a task meets again are not counted again."""
    spark = docs.sparkSession
    ship(spark)
    names = ["doc_id", "t1", "t2", "sig", "n", *[f"s{i}" for i in range(WORDS)], "slots", "counts"]
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * WORDS + [pa.list_(pa.int32()), pa.list_(pa.int64())]

    def rows(batches):
        counts, seen = np.zeros(SLOTS, np.int64), _Seen()
        for b in _slices(batches):
            sig, size, sketches, fresh = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_set(t, k)
                sig.append(set_key(h))
                size.append(len(h))
                sketches.append(parity_sketch(h))
                if seen.first(sig[-1]):
                    fresh.append(h & (SLOTS - 1))
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=SLOTS)
            sketch = np.ascontiguousarray(np.array(sketches, np.int64).reshape(len(sig), WORDS).T)
            made = [b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(sig, pa.int64()), pa.array(size, pa.int32()), *[pa.array(s) for s in sketch]]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(sig), kinds[-2]), pa.nulls(len(sig), kinds[-1])], names)
        _hashes.clear()
        step = 1 << 14
        for i in range(0, SLOTS, step):
            at = np.flatnonzero(counts[i : i + step])
            if len(at):
                made = [pa.array([x], t) for x, t in (((at + i).astype(np.int32), kinds[-2]), (counts[i + at], kinds[-1]))]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:-2]], *made], names)

    schema = "doc_id long, t1 long, t2 long, sig long, n int, " + ", ".join(f"s{i} long" for i in range(WORDS)) + ", slots array<int>, counts array<bigint>"
    both = written(docs.select("doc_id", "t1", "t2", "text").mapInArrow(rows, schema), "classes")
    each = both.where("slots is not null").select(F.inline(F.arrays_zip("slots", "counts"))).groupBy("slots").agg(F.sum("counts").alias("c"))
    found = each.toArrow()  # SLOTS rows at most, as Arrow columns
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[found["slots"].to_numpy()] = found["c"].to_numpy()
    return both.where("slots is null").drop("slots", "counts"), counts


def prefix_index(docs: DataFrame, counts: np.ndarray, k: int, percent: int, frequent: int, salt_rows: int = 20_000) -> DataFrame:
    """key, salt, sig, n, room of every class (repeated where several tasks meet copies); keys of tokens in more than
    `salt_rows` classes are dealt over up to 64 salts."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    limit = float(counts.mean()) + frequent
    names = ["key", "salt", "sig", "n", "room"]

    def keys(batches):
        seen = _Seen()
        for b in _slices(batches):
            found, sig, size, room, salt = [], [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_set(t, k)
                s = set_key(h)
                if len(h) and seen.first(s):
                    key, left, c = prefix_keys(h, shared.value, percent, limit)
                    found.append(key)
                    room.append(left)
                    salt.append(s % np.minimum(64, 1 + c // salt_rows))
                    sig.append(np.full(len(key), s, np.int64))
                    size.append(np.full(len(key), len(h), np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((found, np.int64), (salt, np.int32), (sig, np.int64), (size, np.int32), (room, np.int32))], names)
        _hashes.clear()

    return written(docs.select("text").mapInArrow(keys, "key long, salt int, sig long, n int, room int"), "prefixes")


def _differ(percent: int):
    """How many tokens two linked sets of nx and ny tokens can differ in, at most."""
    return F.expr(f"nx + ny - 2 * ceil({percent}D * (nx + ny) / {100 + percent})")


def _met(a: DataFrame, b: DataFrame, on: list[str], percent: int, *more) -> DataFrame:
    """x, nx, y, ny: different classes that meet under a key whose room is enough, the smaller first, each pair once.

    a, b: sig, n, room and the columns `on`; b's are named with a 2. more: further conditions.
    """
    turn = F.expr("(n < n2) or (n = n2 and sig < sig2)")
    fits = (F.least("room", "room2") * (100 + percent) >= percent * (F.col("n") + F.col("n2"))) & (F.least("n", "n2") * 100 >= percent * F.greatest("n", "n2"))
    met = a.join(b, on).where((F.col("sig") != F.col("sig2")) & fits)
    for condition in more:
        met = met.where(condition)
    pick = lambda one, other, name: F.when(turn, F.col(one)).otherwise(F.col(other)).alias(name)
    return met.select(pick("sig", "sig2", "x"), pick("n", "n2", "nx"), pick("sig2", "sig", "y"), pick("n2", "n", "ny")).distinct()


class _Verifier:
    """Verifies pairs of classes; the sets it has read once are kept as written tables."""

    def __init__(self, docs: DataFrame, rows: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent, self.sets = docs, k, percent, None
        first = [F.first(f"s{i}").alias(f"s{i}") for i in range(WORDS)]
        self.heads = written(rows.where("n > 0").groupBy("sig", "n").agg(F.min(F.struct("t1", "t2")).alias("t"), *first), "class-heads")

    def read(self, wanted: DataFrame) -> None:
        """Read the sets of the classes `wanted` (sig, n) that are not known yet."""
        k = self.k

        def sets(batches):
            seen = _Seen()
            for b in _slices(batches):
                made = [(h, set_key(h)) for h in (shingle_set(t, k) for t in b.column("text").to_pylist())]
                made = [(h, s) for h, s in made if seen.first(s)]
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s in made], pa.int64()), pa.array([len(h) for h, _ in made], pa.int32()), pa.array([h for h, _ in made], pa.list_(pa.int64()))], ["sig", "n", "hs"])
            _hashes.clear()

        if self.sets is not None:
            wanted = wanted.join(self.sets.select("sig", "n"), ["sig", "n"], "left_anti")
        texts = written(self.heads.join(wanted, ["sig", "n"], "left_semi").select("t.t1", "t.t2"), "texts-to-read")
        found = self.docs.join(texts, ["t1", "t2"], "left_semi").select("text").mapInArrow(sets, "sig long, n int, hs array<long>")
        found = written(found.dropDuplicates(["sig", "n"]), "class-sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The rows of `pairs` (x, nx, y, ny) that are links."""
        ends = lambda e, o: self.heads.select(F.col("sig").alias(e), F.col("n").alias(f"n{e}"), *[F.col(f"s{i}").alias(f"{o}{i}") for i in range(WORDS)])
        apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(WORDS)), F.lit(0))
        pairs = pairs.join(ends("x", "a"), ["x", "nx"]).join(ends("y", "b"), ["y", "ny"]).where(apart <= _differ(self.percent)).select("x", "nx", "y", "ny")
        pairs = written(pairs, f"{name}-candidates")
        self.read(pairs.select(F.explode(F.array(F.struct(F.col("x").alias("sig"), F.col("nx").alias("n")), F.struct(F.col("y").alias("sig"), F.col("ny").alias("n")))).alias("e")).select("e.*").distinct())
        of = lambda e, o: self.sets.select(F.col("sig").alias(e), F.col("n").alias(f"n{e}"), F.col("hs").alias(o))
        both = pairs.join(of("x", "a"), ["x", "nx"]).join(of("y", "b"), ["y", "ny"])  # what many pairs share comes first, so that no task gathers its copies
        common = F.size(F.array_intersect("a", "b")).cast("long")
        found = both.select("x", "nx", "y", "ny", common.alias("common")).where(F.col("common") * 100 >= (F.col("nx") + F.col("ny") - F.col("common")) * self.percent)
        return written(found.drop("common"), f"{name}-links")


def _groups(links: DataFrame) -> DataFrame:
    """sig, n, component (struct) of the classes with links."""
    node = lambda s, n: F.struct(F.col(n).alias("n"), F.col(s).alias("sig"))
    found = connected_components(links.select(node("x", "nx").alias("a"), node("y", "ny").alias("b")))
    return found.select(F.col("node.sig").alias("sig"), F.col("node.n").alias("n"), "component")


def _joined(found: DataFrame, across: DataFrame) -> DataFrame:
    """sig, n, component of the classes of `found` (sig, n, group) and of the links `across` groups; of many links between two
    groups one is followed."""
    ends = across.select(F.explode(F.array(F.struct(F.col("x").alias("sig"), F.col("nx").alias("n")), F.struct(F.col("y").alias("sig"), F.col("ny").alias("n")))).alias("e")).select("e.*").distinct()
    single = ends.join(found, ["sig", "n"], "left_anti").select("sig", "n", F.struct("n", "sig").alias("group"))
    every = written(found.select("sig", "n", "group").unionByName(single), "group-members")
    of = lambda e, o: every.select(F.col("sig").alias(e), F.col("n").alias(f"n{e}"), F.col("group").alias(o))
    edges = across.join(of("x", "a"), ["x", "nx"]).join(of("y", "b"), ["y", "ny"]).select("a", "b").distinct()
    merged = connected_components(edges).select(F.col("node").alias("group"), "component")
    return written(every.join(merged, "group", "left").select("sig", "n", F.coalesce("component", "group").alias("component")), "groups")


def common_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Tokens that each two of the sets share."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(sets), len(sets)))
    for a in range(0, len(every), width):
        lo, hi = np.searchsorted(place, [a, a + width])
        block = np.zeros((len(sets), min(width, len(every) - a)), np.float32)
        block[row[lo:hi], place[lo:hi] - a] = 1
        out += block @ block.T
    return out


def link_counts(groups: DataFrame, links: DataFrame, sets: DataFrame, percent: int, rows: int = 256, tokens: int = 200_000) -> DataFrame:
    """sig, n, n_links: how many classes each class of `groups` is linked with.

    A group whose links are all known is counted from them. The others are cut into parts of about `rows` classes and
    `tokens` tokens, and every two parts of a group are compared as one tile, so a set moves once for each part of its
    group and pairs are never listed.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    known = links.join(groups.select(F.col("sig").alias("x"), F.col("n").alias("nx"), "component"), ["x", "nx"]).groupBy("component").agg(F.count("*").alias("known"))
    sizes = written(sizes.join(known, "component"), "group-sizes")
    full = F.col("known") * 2 == F.col("m") * (F.col("m") - 1)
    easy = groups.join(sizes.where(full), "component").select("sig", "n", (F.col("m") - 1).alias("n_links"))
    open_groups = sizes.where(~full).select("component", F.ceil(F.greatest(F.col("m") / rows, F.col("tokens") / tokens)).cast("int").alias("parts"))
    load = sizes.where(~full).agg(F.sum("tokens")).first()[0] or 0
    deals = max(1, int(load // 1_000_000))
    member = groups.join(open_groups, "component").withColumn("part", F.pmod(F.xxhash64("sig", "n"), F.col("parts")).cast("int"))
    tiles = member.select("sig", "n", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("sig", "n", "part", F.struct(F.col("component"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).alias("tile"))
    tiles = tiles.withColumn("deal", F.when(F.col("tile.hi") == 0, F.pmod(F.xxhash64("tile"), F.lit(deals))).otherwise(F.xxhash64("tile")))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in pdf.groupby("tile_key", sort=False):
            n, part = tile["n"].to_numpy().astype(np.int64), tile["part"].to_numpy()
            common = common_counts(list(tile["hs"]))
            linked = common * 100 >= (n[:, None] + n[None, :] - common) * percent
            np.fill_diagonal(linked, False)
            if part.min() < part.max():
                linked &= part[:, None] != part[None, :]
            out.append(pd.DataFrame({"sig": tile["sig"], "n": tile["n"], "n_links": linked.sum(1)}))
        return pd.concat(out)

    met = tiles.join(sets, ["sig", "n"]).select("deal", F.xxhash64("tile").alias("tile_key"), "part", "sig", "n", "hs")
    counted = met.groupBy("deal").applyInPandas(count, "sig long, n int, n_links long").groupBy("sig", "n").agg(F.sum("n_links").alias("n_links"))
    return easy.unionByName(counted)


def _open(index: DataFrame, groups: DataFrame) -> DataFrame:
    """key, sig, n, room, group of the keys of `index` under which classes of several groups stand."""
    own = index.join(groups.withColumnRenamed("component", "group"), ["sig", "n"], "left").select("key", "sig", "n", "room", F.coalesce("group", F.struct("n", "sig")).alias("group"))
    several = own.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("key")
    return written(own.join(several, "key", "left_semi").dropDuplicates(["key", "sig", "n"]), "open-prefixes")


def _across(own: DataFrame, heads: DataFrame, percent: int, crowd: int = 64, tile: int = 4_000) -> DataFrame:
    """x, nx, y, ny: classes of different groups that meet under a key of `own` (see `_open`).

    Under keys with more than `crowd` classes, as those of a passage that many texts share, most pairs are no links: there the
    sketches come along and are compared inside the join. Such keys are dealt to tiles of about `tile` classes.
    """
    counts = own.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > crowd)
    crowded = written(counts.select("key", F.ceil(F.col("c") / tile).cast("int").alias("parts")), "crowded-keys")
    sketch, named = [f"s{i}" for i in range(WORDS)], ["sig", "n", "room", "group"]
    apart = F.col("group") != F.col("group2")
    calm = own.join(small(crowded), "key", "left_anti")
    found = _met(calm, calm.select("key", *[F.col(c).alias(f"{c}2") for c in named]), ["key"], percent, apart)
    if crowded.isEmpty():
        return found
    dense = own.join(small(crowded), "key").join(heads.select("sig", "n", *sketch), ["sig", "n"]).withColumn("part", F.pmod(F.xxhash64("sig", "n"), F.col("parts")).cast("int"))
    left = dense.select("key", *named, *sketch, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = dense.select("key", "part", *[F.col(c).alias(f"{c}2") for c in named], *[F.col(c).alias(f"other_{c}") for c in sketch])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in sketch), F.lit(0))
    near = differ <= F.expr(f"n + n2 - 2 * ceil({percent}D * (n + n2) / {100 + percent})")
    return found.unionByName(_met(left, right, ["key", "part"], percent, apart, near)).distinct()


def grouped(docs: DataFrame, k: int, percent: int, frequent: int, counts: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of `docs` (doc_id, t1, t2, text): rows as `shingle_classes` gives them; groups: sig, n, component and, with
    `counts`, n_links of every class that has links."""
    rows, table = shingle_classes(docs, k)
    index = prefix_index(docs, table, k, percent, frequent)
    verify = _Verifier(docs, rows, k, percent)
    dealt = index.repartition("key", "salt")  # moved once for both sides
    # each key has a leader of its own, for in a large group of near copies one class alone is linked with too few
    leader = F.min_by(F.struct("sig", "n", "room"), F.struct(F.xxhash64("key", "sig"), "sig"))
    least = dealt.groupBy("key", "salt").agg(leader.alias("l"), F.min("sig").alias("first"), F.max("sig").alias("last")).where("first < last")
    least = least.select("key", "salt", F.col("l.sig").alias("sig2"), F.col("l.n").alias("n2"), F.col("l.room").alias("room2"))
    links = verify.links(_met(dealt, least, ["key", "salt"], percent), "star")
    groups = written(_groups(links), "star-groups")
    own = _open(index.repartition("key"), groups)
    across = verify.links(_across(own, verify.heads, percent), "across")
    links, groups = links.unionByName(across), _joined(groups.withColumnRenamed("component", "group"), across)
    if counts:
        groups = groups.join(link_counts(groups, links, verify.sets, percent), ["sig", "n"])
    return rows.select("doc_id", "t1", "t2", "sig", "n"), groups


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def link_components(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 1000) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, n_links.

    Two rows are linked when 100 |A & B| >= percent |A | B| for their sets of k-word shingles (see `shingle_set`).
    component_id is the smallest doc_id that links lead to, itself included; n_links counts links to other classes of
    equal sets. Rows without words, nulls included, have no shingles and no links. Repeated ids stay as rows; an
    empty table gives an empty one; extra columns are ignored. Rows without doc_id are compared like all others but lend
    their group no id; a group of such rows alone has a null component_id.
    """
    rows, groups = grouped(_keyed(docs), k, percent, frequent, counts=True)
    heads = rows.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("head"))
    least = heads.join(groups, ["sig", "n"]).groupBy("component").agg(F.min("head").alias("least"))
    of_class = groups.join(least, "component").select("sig", "n", F.lit(True).alias("linked"), "least", "n_links")
    classes = heads.join(of_class, ["sig", "n"], "left").select("sig", "n", F.when(F.col("linked"), F.col("least")).otherwise(F.col("head")).alias("least"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    met = rows.join(classes, ["sig", "n"], "left")
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_group(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 1000) -> DataFrame:
    """One row of each group of near-duplicate documents, all columns of `docs`: that of the least doc_id (nulls last, then by the
    hash of the text). Rows without words, null texts included, all stay; different texts that share an id are different
    documents; of rows with one id and one text, one stays. An empty table stays empty.
    """
    own = _keyed(docs)
    rows, groups = grouped(own, k, percent, frequent, counts=False)
    group = F.coalesce("component", F.struct("n", "sig"))
    best = rows.where("n > 0").join(groups, ["sig", "n"], "left").groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t1", "t2")).alias("b"))
    heads = written(best.select(F.struct("b.doc_id", "b.t1", "b.t2").alias("key")), "group-heads")
    twice = rows.where("n > 0").groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("c")).where("c > 1")
    heads = heads.join(twice.select(F.struct("doc_id", "t1", "t2").alias("again")), F.col("key").eqNullSafe(F.col("again")), "left").select("key", F.col("again").isNotNull().alias("twice"))
    wordless = F.trim(F.translate(text_of(), "\t\n\v\f\r", "     ")) == ""
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("t1"), F.xxhash64(F.lit(1), text_of()).alias("t2")).alias("key"), wordless.alias("wordless"))
    met = keyed.where("not wordless").join(written(heads, "heads"), "key")
    kept = met.where("not twice").select("row").unionByName(met.where("twice").dropDuplicates(["key"]).select("row"))
    return keyed.where("wordless").select("row").unionByName(kept).select("row.*")
