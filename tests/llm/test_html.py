"""Wrapper induction on generated hosts without any tag or class that tells, against a plain aligner."""

import random

from graphcv.llm import html_wrapper

WORDS = "river stone cloud green paper walks under bright seven winter table over light music garden".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + f" {rng.randrange(10**6)}."


def site(rng, host, pages):
    """Pages of one host and their articles: menu, advert, related links and footer are the same on all; articles vary."""
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 5))
    advert, foot, related = prose(rng, 12), prose(rng, 9), [prose(rng, 90) for _ in range(3)]
    order, made = rng.random() < 0.5, []
    for i in range(pages):
        blocks = [prose(rng, 5)] + [prose(rng, rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
        body = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        if rng.random() < 0.4:
            items = [prose(rng, 6) for _ in range(3)]
            body += "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
            blocks += items
        extra = "<div class=k9><p>" + advert + "</p></div>" if rng.random() < 0.7 else ""
        parts = [f"<div class=k1><ul>{menu}</ul></div>", extra, f"<div class='k2 x{i}'>{body}</div>", "<div class=k3>" + "".join(f"<p>{r}</p>" for r in related) + "</div>", f"<div class=k4>{foot}</div>"]
        if order:
            parts = [parts[0], parts[3], parts[1], parts[2], parts[4]]
        made.append((f"https://{host}/{i}", "<html><body>" + "".join(parts) + "</body></html>", blocks))
    return made


def plain(pages):
    """The text blocks of each page that are not on nearly all pages of the host."""
    seen = {}
    for k, p in enumerate(pages):
        for _, text in html_wrapper.parse(p)[2]:
            seen.setdefault(text, set()).add(k)
    return [[t for _, t in html_wrapper.parse(p)[2] if len(seen[t]) < 0.4 * len(pages)] for p in pages]


def test_hosts_without_telling_tags(spark):
    rng = random.Random(8)
    rows, truth, aligned = [], {}, {}
    for h in range(4):
        made = site(rng, f"h{h}.org", 25)
        for (url, page, blocks), own in zip(made, plain([m[1] for m in made]), strict=True):
            truth[len(rows)], aligned[len(rows)] = blocks, own
            rows.append((len(rows), url, page))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text.split("\n") for r in html_wrapper.extract_pages(table).collect()}
    right = sum(len(set(found[i]) & set(truth[i])) for i in truth)
    assert right == sum(map(len, truth.values())) == sum(len(found[i]) for i in truth)  # recall 1, precision 1
    assert found == aligned
    alone = {r.page_id: r.text.split("\n") for r in html_wrapper.extract_pages(table, induce=False).collect()}
    assert sum(alone[i] != truth[i] for i in truth) > 50  # without its host, a page keeps its menu and footer


def test_templates_keep_their_slots(spark):
    page = "<body><div class=a><p>Yes</p><p>Constant</p></div><div class=b><h2>{0}</h2><p>{1}</p><p>words that vary {0} times and are more than the rest</p></div>"
    rows = [(i, f"http://h/{i}", page.format(i, "Yes" if i == 3 else f"no {i}")) for i in range(10)]
    found = {r.page_id: r.text.split("\n") for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == ["3", "Yes", "words that vary 3 times and are more than the rest"] and found[4][1] == "no 4"


def test_whole_articles(spark):
    rows = [
        (1, None, "<main><h1>T</h1></main><div><p>Whole article of many words, and more of them</p><p>b</p></div>"),
        (2, None, "<article><h1>A</h1><div class='share-price notice-board'>1.25 up</div><p>x</p></article>"),
        (3, None, "<p data=it's>Hello 'quoted</p><p>tail's end</p>"),
        (4, None, "<div>" * 3000 + "deep" + "</div>" * 3000),
        (5, None, "<article>" + "<p>word &amp; more</p>" * 20000 + "</article>"),
    ]
    found = {r.page_id: r.text for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "Whole article" in found[1] and found[2] == "A\n1.25 up\nx" and found[3] == "Hello 'quoted\ntail's end" and found[4] == "deep"
    assert found[5] == "\n".join(["word & more"] * 20000)


def test_alignment_by_trying_all():
    """Against all order-keeping matchings of small trees."""
    rng = random.Random(3)

    def tree(n):
        up = [-1] + [rng.randrange(max(0, i - 3), i) for i in range(1, n)]
        order, kids = [], {i: [j for j in range(n) if up[j] == i] for i in range(n)}
        waiting = [0]
        while waiting:
            i = waiting.pop()
            order.append(i)
            waiting.extend(reversed(kids[i]))
        at = {i: k for k, i in enumerate(order)}
        return [at.get(up[i], -1) for i in order], [("r" if i == 0 else rng.choice("ab")) for i in order]

    def most(a, b, i, j):
        if a[1][i] != b[1][j]:
            return 0
        x, y = ([k for k, p in enumerate(t[0]) if p == n] for t, n in ((a, i), (b, j)))

        def best(p, q):
            if p == len(x) or q == len(y):
                return 0
            return max(best(p + 1, q), best(p, q + 1), most(a, b, x[p], y[q]) + best(p + 1, q + 1))

        return 1 + best(0, 0)

    for _ in range(60):
        a, b = tree(rng.randint(1, 9)), tree(rng.randint(1, 9))
        pairs = html_wrapper.tree_match(a, b)
        assert len(pairs) == most(a, b, 0, 0)
        assert all(a[1][i] == b[1][j] and (i == 0 or pairs[a[0][i]] == b[0][j]) for i, j in pairs.items())
