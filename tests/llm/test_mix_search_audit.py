"""Source mixing, ranked search and the source audit: against their SQL, plain versions and odd tables."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcv.llm import impact_index, queries, source_audit, source_mix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, s string, term string, rank string, n_chars int"
ROWS = [
    (1, None, None, None, "x", "y", "z", None),
    (2, "", "en", "a", None, None, None, 0),
    (3, " \n\t ", "en", "a", None, None, None, 4),
    (4, "lorem ipsum dolor sit amet " * 4000, "en", "b", None, None, None, 9),
    (5, "one two three four five six", "en", "b", None, None, None, 27),
    (5, "one two three four five six", "en", "b", None, None, None, 27),
    (None, "one two three four five six", "de", "c", None, None, None, 27),
    (6, "é日本 𝔘 <s> x\x00y", "fr", "", None, None, None, 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_impact_index", "op13_source_audit"])
def test_equals_sql(spark, tables, name):
    df = queries.queries()[name](spark, SF)
    found = tables.execute(queries.oracle_sql()[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, df.select(*order).collect()), key=key) == sorted(found.fetchall(), key=key)


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix_of_odd_rows(docs):
    found = source_mix.mix_sources(docs).collect()
    assert len(found) == len(ROWS)
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert sizes == {None: 0, "a": 0, "b": 20012, "c": 6, "": 4}
    expected = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    for s, target in expected.items():
        own = [r for r in found if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] for r in own)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in found)
    assert source_mix.mix_sources(docs.limit(0)).collect() == []


def test_mix_of_equal_rows_and_hot_sources(spark):
    """100,000 equal rows in one source: the boundary is found among them by their places, and the words are met to a document."""
    equal = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words in all of them").alias("text"), F.lit("hot").alias("source"))
    rng = random.Random(3)
    others = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 60)), f"s{i % 7}") for i in range(700)], "doc_id long, text string, source string")
    found = source_mix.mix_sources(equal.unionByName(others)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.max("copies").alias("copies"))
    rows = {r.source: r for r in found.collect()}
    expected = plain_targets({s: r["size"] for s, r in rows.items()}, (5, 2, 1), 1.5, 2)
    for s, r in rows.items():
        assert r.target == pytest.approx(expected[s]) and abs(r.taken - r.target) <= 5 and r.copies <= 2


def test_mix_repeats_and_draws(docs, spark):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 300)), f"s{i % 2}") for i in range(600)], "doc_id long, text string, source string")
    draw = lambda d, seed: {r.doc_id: r.copies for r in source_mix.mix_sources(d, share=0.6, seed=seed).collect()}
    first, again, other = draw(table, 1), draw(table.repartition(5), 1), draw(table, 2)
    assert first == again and first != other
    long, short = [i for i in range(600) if i % 2 and len(table.collect()[i].text) > 300], [i for i in range(600) if i % 2 and len(table.collect()[i].text) < 60]
    mean = lambda ids: sum(first[i] + other[i] for i in ids) / (2 * len(ids))
    assert mean(long) > mean(short)  # wanted by the digits of their sizes


def test_planes_add_and_rank():
    rng = np.random.default_rng(5)
    for terms, top in ((1, 5), (2, 1), (7, 1 << 34), (40, 1 << 20), (3, 0)):
        values = [rng.integers(0, top + 1, 192) * (rng.random(192) < 0.4) for _ in range(terms)]
        maps = [impact_index.planes(v, int(v.max()).bit_length()) for v in values]
        maps = [m.view(np.uint64) if len(m) else np.zeros((0, 3), np.uint64) for m in maps]
        sums, total = impact_index.add_planes(maps, 3), sum(values)
        for k in (1, 5, 50, 500):
            places, scores = impact_index.best_places(sums, k)
            expected = sorted(((-int(t), i) for i, t in enumerate(total) if t > 0))[:k]
            assert sorted((-int(s), int(p)) for s, p in zip(scores, places, strict=True)) == expected


def plain_search(rows, items, k):
    docs = [(i, [t.decode() for t in impact_index.split_terms(x)]) for i, x in rows]
    docs = [(i, t) for i, t in docs if t]
    n, total = len(docs), sum(len(t) for _, t in docs)
    out = set()
    for item, text in set(items):
        scores = []
        for i, t in docs:
            m, score = 50 + (50 * len(t) * n) // total, 0
            for term in {x.decode() for x in impact_index.split_terms(text)}:
                df, tf = sum(term in u for _, u in docs), t.count(term)
                score += int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1)))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])}
    return out


def test_search_odd_rows(spark, docs, monkeypatch):
    items = [(1, "ONE two, two zebra"), (2, None), (3, ""), (1, "ONE two, two zebra"), (4, "日本 x lorem five"), (None, "amet")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in ROWS]
    for block in (8192, 2):
        monkeypatch.setattr(impact_index.postings, "__defaults__", (block, 4_000_000))
        found = {tuple(r) for r in impact_index.rank_documents(docs, bench, 3).select("item_id", "rank", "doc_id", "score").collect()}
        assert found == plain_search(rows, [(i, t) for i, t in items if t], 3)
    assert impact_index.rank_documents(docs.limit(0), bench).collect() == [] and impact_index.rank_documents(docs, bench.limit(0)).collect() == []


def test_search_ties(spark):
    """Copies have equal scores: the least ids are in the list, whatever blocks they stand in."""
    table = spark.range(3000).select((F.lit(5000) - F.col("id")).alias("doc_id"), F.lit("alpha beta gamma").alias("text")).repartition(4)
    bench = spark.createDataFrame([(1, "alpha delta")], "item_id long, text string")
    other = spark.range(9000, 10_000).select(F.col("id").alias("doc_id"), F.lit("epsilon zeta eta").alias("text"))
    found = impact_index.rank_documents(table.unionByName(other), bench).orderBy("rank").collect()
    assert [r.doc_id for r in found] == list(range(2001, 2051)) and len({r.score for r in found}) == 1


def test_index_of_all_terms(spark):
    """Without a list of terms the index has all of them."""
    table = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "doc_id long, text string")
    index, blocks = impact_index.build_index(table)
    assert {r.term for r in index.collect()} == {"a", "b", "c"} and sorted(i for r in blocks.collect() for i in r.ids) == [1, 2]


def test_top_rows_and_ties(spark):
    rng = random.Random(6)
    rows = [(g, f"{'ab' * rng.randint(0, 3)}{rng.choice('éz日a')}{i:04d}", rng.choice([1, 7, 1023, 1 << 29, rng.randrange(1 << 30)])) for g in range(4) for i in range((5, 50, 51, 400)[g])]
    table = spark.createDataFrame(rows, "g int, t string, v long")
    found = {(r.g, r.t, r.v) for r in source_audit.top_rows(table, ["g"], "v", "t", 50).collect()}
    assert found == {x for g in range(4) for x in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:50]}


def test_share_is_exact(spark):
    cases = [(0, 1, 1), (5, 5, 2), (10**12, 3 * 10**12, 10**6), (7, 9, 0), (123456789, 987654321, 4321)]
    table = spark.createDataFrame(cases, "n long, total long, terms long")
    found = {(r.n, r.total, r.terms): r.p for r in table.select("*", source_audit.share("n", "total", "terms").alias("p")).collect()}
    assert found == {c: 1 + (10**9 * (c[0] + 5)) // (c[1] + 5 * c[2]) if c[2] else 0 for c in cases}


def plain_pairs(shares, groups):
    out = set()
    for lang, a, base_a, terms in groups:
        for other, b, base_b, _ in groups:
            if other == lang and a != b:
                names = {t for (l, _, t) in shares if l == lang}
                value = sum(abs(shares.get((lang, a, t), base_a) - shares.get((lang, b, t), base_b)) for t in names) + (terms - len(names)) * abs(base_a - base_b)
                out.add((lang, a, b, value))
    return out


@pytest.mark.parametrize(("block", "tile"), [(10, 3), (20_000, 200)])
def test_pairs_of_many_sources(spark, block, tile):
    rng = random.Random(7)
    groups = [(lang, f"s{i}", rng.randint(1, 9), 12) for lang in ("en", "de") for i in range((11, 2)[lang == "de"])]
    shares = {(lang, s, f"t{t}"): base + rng.randint(0, 40) for lang, s, base, _ in groups for t in range(12) if rng.random() < 0.5}
    table = spark.createDataFrame([(*k, v) for k, v in shares.items()], "lang string, source string, term string, p long")
    known = spark.createDataFrame(groups, "lang string, source string, base long, terms long")
    found = {tuple(r) for r in source_audit.pair_divergence(table, known, block, tile).select("lang", "source", "item", "value").collect()}
    assert found == plain_pairs(shares, groups)


def test_audit_of_odd_rows(docs):
    found = source_audit.audit_sources(docs, min_docs=1).collect()
    assert {(r.lang, r.source, r["item"]) for r in found if r.part == "pair"} == {("en", "a", "b"), ("en", "b", "a")}
    assert all(r.value == 0 and r["rank"] == 1 for r in source_audit.audit_sources(docs, min_docs=50).collect() if r.part == "pair")
    assert source_audit.audit_sources(docs.limit(0)).collect() == []
    assert not [r for r in source_audit.audit_sources(docs, min_docs=50).collect() if r.part == "term"]
