"""Every stage of the pipeline against a plain version, on the small tables."""

import re
import zlib

import pytest

import corpus_pipeline
from graphcv.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    SF = "/root/testdata/sf0.01"  # labels enough to learn from
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    rows = docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    civil = by_name["toxicity"](spark, docs, SF).collect()
    kept = {r.doc_id for r in civil}
    known = [r.doc_id for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert sum((i in kept) == (labels[i] == 0) for i in known) >= 0.95 * len(known)  # 45 toxic rows to learn from

    here = spark.createDataFrame(civil, docs.schema)
    cut = by_name["line dedup"](spark, here, SF)
    assert cut.columns == columns and cut.count() == len(civil)
    sites, texts = {}, {}
    for r in civil:
        for line in set(x.strip(" ").lower() for x in r.text.split("\n")) - {""}:
            sites.setdefault(line, set()).add(r.source)
            texts.setdefault(line, set()).add(r.text)
    gone = {x for x in sites if len(sites[x]) >= 10 and len(texts[x]) >= 10}
    expected = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" ").lower() not in gone) for r in civil}
    assert {r.doc_id: r.text for r in cut.collect()} == expected

    one = by_name["n-gram Jaccard join"](spark, cut, SF)
    sets = {}
    for i, t in expected.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.lower()) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in one.collect()} == {find(i) for i in sets}

    clean = by_name["benchmark decontamination"](spark, one, SF)
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not any(x in norm(r.text) for x in items)}
    assert by_name["SentencePiece encoding"](spark, clean, SF).count() == clean.count()


def test_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (1, "quite another text that is here", "en", "s", 1), (3, None, "en", None, 1), (None, "", None, "s", 1)]
    one = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r.doc_id or 0) for r in one) == [0, 1, 1, 3]  # different texts are different documents, whatever their id


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


def test_scores_need_no_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trained = toxicity.train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    with_columns = toxicity.score_toxicity(docs, trained).select("doc_id", "score").collect()
    alone = toxicity.score_toxicity(docs.select("doc_id", "text"), trained).select("doc_id", "score").collect()
    assert sorted(with_columns) == sorted(alone)
