"""Operators that SQL cannot express, against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from graphcv.llm import decontamination, html_wrapper, jaccard_join, kneser_ney, rindex_dedup, sentencepiece_bpe, simhash, toxicity
from graphcv.llm.components import connected_components

SYLLABLES = "the and er ing ion ou th st re in on es ble ly".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 160)) for _ in range(60)]
    for i in range(20):
        words = texts[i].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 90)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)] + texts[:5] + ["ab" * 500, "", passage]
    table = {i * 3: t for i, t in enumerate(texts)}
    return table, spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("frequent", "crowd"), [(3, 64), (1000, 64), (1000, 1)])
@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(corpus, k, percent, frequent, crowd, monkeypatch):
    monkeypatch.setattr(jaccard_join._across, "__defaults__", (crowd, 3 if crowd == 1 else 4_000))
    texts, docs = corpus
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    links = {i: {frozenset(sets[j]) for j in sets if sets[i] and sets[j] != sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in sets}
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.link_components(docs, k, percent, frequent).collect()}
    assert found == {i: (len(sets[i]), find(i), len(links[i])) for i in sets}


@pytest.mark.parametrize("shard_bytes", [1, 600, 4000])
def test_repeats(corpus, shard_bytes):
    texts, docs = corpus
    raw, length = {i: t.encode() for i, t in texts.items()}, 100
    seen = collections.Counter(x[i : i + length] for x in raw.values() for i in range(len(x) - length + 1))
    found = {r.doc_id: r for r in rindex_dedup.remove_repeats(docs, length, gram=40, shard_bytes=shard_bytes).collect()}
    for k, x in raw.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        assert (found[k].n_removed, found[k].n_spans, bytes(found[k].kept)) == (sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)


def test_repeats_of_an_owner_of_many_kinds(spark):
    rng, length = random.Random(8), 400
    shared, letters = prose(rng, 60)[:330], "abcdefgh "
    own = lambda k: "".join(rng.choices(letters, k=k))
    texts = [own(70) + shared + own(70) for _ in range(5_000)]
    for i in range(0, 600, 3):  # pairs that share 395 to 410 bytes, on the left or on the right
        k = 65 + i // 3 % 16
        texts[i + 1] = texts[i][70 - k : 400] + own(80) if i % 2 else own(80) + texts[i][70 : 400 + k]
    seen = collections.Counter(x for t in texts for x in {hash(t[i : i + length]) for i in range(len(t) - length + 1)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in rindex_dedup.remove_repeats(docs, length, text=False, shard_bytes=200_000).collect()}
    expected = {}
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        expected[k] = (sum(gone), len(re.findall(b"\1+", bytes(gone))))
    assert found == expected and sum(n > 0 for n, _ in expected.values()) > 100


def test_copies_of_a_crowded_passage_are_not_met_in_one_task(spark):
    rows = [(i, -i, 0, 400, 7 if i % 2 else i, 9) for i in range(4_000)] + [(i, -i, 500, 900, 8 + i // 4, 1) for i in range(40)]
    cuts = rindex_dedup.written(spark.createDataFrame(rows, "t1 long, t2 long, a long, b long, h long, c long").repartition(8), "cuts")
    counts = collections.Counter(r[4:] for r in rows)
    kinds = spark.createDataFrame([(*k, n) for k, n in counts.items()], "h long, c long, n long")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    saved = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        parts = rindex_dedup._copied(cuts, kinds).rdd.map(tuple).glom().collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sorted(itertools.chain(*parts)) == sorted(r[:4] for r in rows if counts[r[4:]] > 1)
    assert max(map(len, parts)) < 1_000  # in one task, of over 2,000; all 2,000 of one passage before


def test_encoder_equals_library():
    import sentencepiece

    path = sentencepiece_bpe.model_path()
    own, library, rng = sentencepiece_bpe.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    parts = [*"abeinorst  ", "▁", "\n", "é", "日", "\x00", "𝔘", "<", "0", "x", ">", "th", "ing", "    ", "The"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
        assert own.digest(text)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_parts_encoded_together(monkeypatch):
    """Many different words at once, the same as one by one and as the library; no word of usual length is encoded alone."""
    import sentencepiece

    path = sentencepiece_bpe.model_path()
    own, library, rng = sentencepiece_bpe.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(7)
    assert own.ordered
    pieces = [p for p in own.shorter if sentencepiece_bpe.MARK not in p]
    words = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(3_000)] + ["aaaaaaaaaaaaa", "e" * 64, "ininininin", "x"]
    ids, ends = own.together(words)
    for w, a, b in zip(words, [0, *ends], ends):
        assert [own.pieces[i] for i in ids[a:b]] == own._merged(w) == own.backtrack(w)
    a, b = rng.choices(pieces, k=20_000), rng.choices(pieces[:2_000], k=20_000)
    fits = own._all_fit(np.array([own.id[p] for p in a]), np.array([own.id[p] for p in b]))
    assert fits.tolist() == [own._merged(p + q) == [p, q] for p, q in zip(a, b)]
    assert not fits.all() and fits.any()
    texts = [" ".join(rng.choices(words[:-3], k=20)).replace("q", "\n日") for _ in range(200)] + ["", "  ", "\n\n", "日", "▁a ▁"]
    own.AT_ONCE = 2_000
    monkeypatch.setattr(own, "TOGETHER", 10_000)
    monkeypatch.setattr(own, "backtrack", None)
    for t, found in zip(texts, own.digests(texts), strict=True):
        ids = library.encode(t, add_eos=True)
        assert found == (len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids))))


def test_near_fingerprints(spark):
    rng, mask = random.Random(1), (1 << 64) - 1
    prints = [rng.getrandbits(128) for _ in range(40)]
    prints += [p ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for p in prints]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(sign(p >> 64), sign(p & mask)) for p in prints], "hi long, lo long")
    back = lambda hi, lo: (hi & mask) << 64 | lo & mask
    found = {frozenset((back(r.hi, r.lo), back(r.hi2, r.lo2))) for r in simhash.near_fingerprints(table).collect()}
    assert found == {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}


def test_edited_texts(corpus):
    texts, docs = corpus
    found, ids = {r.doc_id: r for r in simhash.fingerprint_documents(docs).collect()}, sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        n, cut = len(texts[k]), len(texts[k]) // 3
        edited = texts[k][: n - cut] + texts[ids[(i + 1) % len(ids)]][:cut]
        assert found[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_perplexity(spark, corpus):
    """Against the formulas, string by string."""
    texts, docs = corpus
    trusted = [t for t in list(texts.values())[:30] if t]
    top = kneser_ney.ORDER
    counts = {top: collections.Counter()} | {n: collections.defaultdict(set) for n in range(1, top)}
    for t in trusted:
        s = "\0" * (top - 1) + t
        counts[top].update(s[i : i + top] for i in range(len(t)))
    for n in range(top - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]].add(g[0])
    number = {n: {g: c if n == top else len(c) for g, c in counts[n].items()} for n in counts}
    model = {}
    for n, table in number.items():
        c = collections.Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
        raw = (1 - 2 * y * c[2] / c[1] if c[1] else 0.5, 2 - 3 * y * c[3] / c[2] if c[2] else 1, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5)
        model[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]
    total, cut = collections.Counter(), collections.Counter()
    for n, table in number.items():
        for g, c in table.items():
            total[n, g[:-1]] += c
            cut[n, g[:-1]] += model[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(number[1]) + 1)
        if not total[n, g[:-1]]:
            return lower
        c = number[n].get(g, 0)
        return ((c - model[n][min(c, 3) - 1] if c else 0) + cut[n, g[:-1]] * lower) / total[n, g[:-1]]

    import math

    from pyspark.sql import functions as F

    known = spark.createDataFrame([(t,) for t in trusted], "text string")
    for r in kneser_ney.perplexities(docs.withColumn("lang", F.lit("en")), known, chars_a_block=5_000, bytes_a_group=2_000).collect():
        t = "\0" * (top - 1) + texts[r.doc_id]
        if r.n_tokens:
            expected = math.exp(-sum(math.log(p(t[i : i + top])) for i in range(r.n_tokens)) / r.n_tokens)
            assert r.perplexity == pytest.approx(expected, rel=1e-9)


def test_strings_of_a_block_are_answered_once():
    """Many tasks list the same strings of a block; the block holds each once in memory, and looks its texts up shard by shard."""
    rng, shards = np.random.default_rng(3), 7
    strings = np.unique(rng.integers(0, 1 << 60, 5_000))
    logp = -rng.random(len(strings))
    asked = rng.choice(strings[:4_000], 20_000)
    lists = {}
    for k in range(shards):
        own = np.flatnonzero(strings % kneser_ney.SPREAD % shards == k)
        listed = np.intersect1d(strings[own], asked)
        found = pd.DataFrame({"block": [5, 9] * 40, "grams": [kneser_ney._packed(np.sort(rng.choice(listed, len(listed) // 2, replace=False)) if i else listed) for i in range(40) for _ in range(2)]})
        model = pd.DataFrame({"gram": strings[own], "logp": logp[own]}).sample(frac=1, random_state=1)
        answers = kneser_ney._answers(found, model)
        assert answers["block"].tolist() == [5, 9]
        lists[k] = (kneser_ney._unpacked(answers["grams"][1]), np.frombuffer(answers["logs"][1]))
        assert lists[k][0].tolist() == listed.tolist()
    assert (kneser_ney._looked_up(asked, lists, shards) == logp[np.searchsorted(strings, asked)]).all()
    with pytest.raises(RuntimeError):
        kneser_ney._looked_up(strings[-1:], lists, shards)



def test_templates(spark):
    items = [(1, "A train leaves Boston at 40 km and Maria waits 3 hours for the 40 km train to Boston.")]
    same = "Some words. A train leaves Paris at 75 km and Peter waits 9 hours for the 75 km train to Paris. More words."
    torn = "A train leaves Paris at 75 km and Peter waits 9 hours for the 80 km train to Rome."
    docs = spark.createDataFrame([(1, same), (2, torn), (3, "A train of thought leaves nothing to wait for.")], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), share=0.9)
    assert [r.doc_id for r in found.collect()] == [1]


def test_names_that_begin_sentences(spark):
    item = "Anna has 12 red apples in a basket. Anna gives 3 of them to her brother. Anna then buys 7 more at the shop. How many apples does Anna have now?"
    other = item.replace("Anna", "Bob").replace("12", "15")
    texts = [(1, item), (2, "Read this. " + other), (3, item.lower()), (4, "Anna and Bob have a brother. How many red apples does the shop have now?")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.5)
    assert {r.doc_id: r.n_matched == r.n_windows for r in found.collect()} == {1: True, 2: True, 3: False}


def test_equal_values_in_two_roles(spark):
    item = "A farmer keeps 2 cows in the old barn near the river and feeds them each morning; later that year the same farmer sells 2 pigs at the market in the town below the hill."
    texts = [(1, item.replace("2 cows", "3 cows").replace("2 pigs", "5 pigs")), (2, item.replace("2 pigs", "two pigs"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.5)
    assert {r.doc_id for r in found.collect()} == {1, 2}


def test_variants_of_a_question(spark):
    item = "Anna has 12 red apples in a basket. Anna gives 3 of them to her brother. Anna then buys 7 more at the shop. How many apples does Anna have now?"
    two = item.replace("Anna", "Mary Ann")
    held = [item, item.upper(), two, item.replace("12", "twelve"), item.replace("Anna", "Bob").replace("12", "fifteen"), two.replace("12", "twenty-one").upper(), item.replace("Anna", "Bob").upper()]
    texts = ["Some text. " + t + " More of it." for t in [*held, "The red apples in a basket are few. How many does Anna have?", "RED APPLES IN A BASKET ARE FEW"]] + ["\n" * 50_000, " . " * 50_000, "A" * 100_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"))
    assert {(r.doc_id, r.n_matched) for r in found.collect()} == {(i, 24) for i in range(len(held))}


def plain_places(text):
    """(forms, value, may begin a name, number of a word) of every place, token by token."""
    out = []
    for m in re.finditer(r"\d+|\w+", text):
        w, starts = m[0], m.start() == 0 or text[: m.start()].endswith(". ")
        if w.isdigit():
            new = (["<num>"], w, False, None)
        elif w.lower() in decontamination.NUMBERS:
            new = (["<num>"], str(decontamination.NUMBERS[w.lower()]), False, decontamination.NUMBERS[w.lower()])
        elif out and out[-1][0] == ["<num>"] and w in decontamination.UNITS:
            new = (["<unit>"], w, False, None)
        elif w[0].isupper():
            new = (["<name>", w.lower()] if starts else ["<name>"], w.lower(), True, None)
        else:
            new = ([w], w, False, None)
        if out and new[0] == ["<name>"] and out[-1][2]:
            out[-1] = (["<name>"], out[-1][1] + " " + new[1], True, None)
        elif out and out[-1][3] == 20 and new[3] == 1:
            out[-1] = (["<num>"], "21", False, new[3])
        else:
            out.append(new)
    return out


def plain_windows(places, size):
    for i in range(len(places) - size + 1):
        for form in itertools.product(*[p[0] for p in places[i : i + size]]):
            yield i, form, [places[i + j][1] for j, f in enumerate(form) if f[0] == "<"]


def plain_match(text, item, window=8, least=5, share=0.5):
    places = plain_places(item)
    if len(places) < least:
        return None
    size = min(window, len(places))
    made = list(plain_windows(places, size))
    chosen = [w for w in made if 2 * len(w[2]) <= size] or made
    shifts = collections.defaultdict(list)
    for pos, form, said in plain_windows(plain_places(text), size):
        for at, own, slots in chosen:
            if own == form:
                shifts[pos - at].append((at, slots, said))
    matched, n = set(), len({at for at, *_ in chosen})
    for hits in shifts.values():
        votes = collections.defaultdict(set)
        for at, slots, said in hits:
            for a, b in zip(slots, said, strict=True):
                votes[a].add((at, b))
        best = {a: min(collections.Counter(b for _, b in v).items(), key=lambda c: (-c[1], c[0]))[0] for a, v in votes.items()}
        matched |= {at for at, slots, said in hits if all(best[a] == b for a, b in zip(slots, said, strict=True))}
    return (n, len(matched)) if len(matched) >= max(1, math.ceil(n * share)) else None


def test_templates_equal_a_plain_matcher(spark):
    rng = random.Random(11)
    pick = lambda: rng.choice(["Anna", "Bob", "Mary Ann", "Jo", str(rng.randint(2, 60)), f"{rng.randint(2, 9)} km", "seven", "twenty one", *"the old man ran to a far town and saw one big red barn by his new house".split()])
    sentence = lambda: (lambda t: t[0].upper() + t[1:] + ".")(" ".join(pick() for _ in range(rng.randint(2, 14))))
    items = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(25)]
    swaps = [("Anna", "Bob"), ("Bob", "Mary Ann"), ("Mary Ann", "Lee"), ("seven", "9"), ("km", "miles"), ("old", "young"), ("the", "this"), ("Jo", "Ann Lee")]
    texts = []
    for t in items * 4:
        for a, b in rng.sample(swaps, rng.randint(0, 3)):
            t = t.replace(a, b, rng.choice([1, -1]))
        texts.append(" ".join([sentence(), t, sentence()]))
    expected = {(d, i, *m) for d, t in enumerate(texts) for i, x in enumerate(items) if (m := plain_match(t, x))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert len(expected) > 50 and {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in found.collect()} == expected


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        words = prose(rng, 60).split() + ["grumble"] * bad + ["folk"] * group  # toxic only together
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad and group)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    import zlib

    held = [(scored[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.93


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: find(i) for i in parent}


def test_pages_by_hand():
    page = '<html><body class="comments-open"><header><h1>Site</h1></header><nav>x</nav><div id="cookie-notice">c</div><main><h2>T &amp; t</h2><p>Hello <a href="x">wor</a>ld<br>two</p>bare <i>text</i><ul><li>one<li>two</ul><div class="ad">buy</div></main><aside>s</aside><section id="comments"><p>lol</p></section><form><p>f</p></form><script>if(a<b)"</p>"</script>'
    assert html_wrapper.lone_text(page) == ["T & t", "Hello world two", "bare text", "one", "two"]
    shapes = [html_wrapper.skeleton(*html_wrapper.parse(p)[:2])[:2] for p in ("<div><p>1</p><ul><li>2</ul><h2>3</h2></div>", "<div><h1>0</h1><p>1</p><h2>3</h2></div>")]
    assert html_wrapper.tree_match(*shapes) == {0: 0, 1: 1, 2: 3, 5: 4}


def test_machine_gradient():
    """Against differences of the loss, with the pairs written out."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = (rng.random((12, 5)) < 0.5).astype(float), (rng.random(12) < 0.4).astype(float)
    p = [np.array([0.1]), rng.normal(size=5), rng.normal(size=(5, 3))]

    def loss(p):
        total = 0.0
        for r, t in zip(x, y, strict=True):
            on = np.flatnonzero(r)
            z = p[0][0] + p[1][on].sum() + sum(p[2][i] @ p[2][j] for i in on for j in on if i < j)
            total += (2.0 if t else 1.0) * (np.log1p(np.exp(z)) - t * z) / len(y)
        return total + 0.5e-5 * (p[1] ** 2).sum() + 0.5e-4 * (p[2] ** 2).sum()

    value, grads = toxicity.loss_gradient(x, y, p, 2.0)
    assert value == pytest.approx(loss(p))
    for k in range(3):
        for at in np.ndindex(p[k].shape):
            moved = [a.copy() for a in p]
            moved[k][at] += 1e-6
            assert grads[k][at] == pytest.approx((loss(moved) - value) / 1e-6, abs=1e-4)


def test_terms_that_tell_in_pairs_only():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.random((3000, 12)) < 0.5
    y = x[:, 2] ^ x[:, 7]  # neither term tells anything alone
    rows = [np.flatnonzero(r) for r in x]
    assert toxicity.paired(rows, y, 12).tolist() == [2, 7]
    model = toxicity.fit_machine(rows, y, 12, weight=1.0)
    assert np.mean([(toxicity.machine_score(list(r), model) >= 0.5) == t for r, t in zip(rows, y, strict=True)]) > 0.95
