"""Main text of web pages by wrapper induction.

Every page becomes a tree of its block elements, with nothing judged yet; runs of siblings of one shape fold into one
node, which leaves a small skeleton. The most common skeleton of a host is its reference, and simple tree matching
aligns every other skeleton of the host with it, so a node of a page is a slot of its host. A text that stands in one
slot of nearly all different pages of the host is template; what varies is content. The wrapper of a host is the region
of its reference that holds most of the varying text; a page's main text is what its nodes aligned with that region
hold, without the template of each slot. Tags, roles and class names only break ties: where the way down stops, and
which lesser parts of the region are no article text.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, written

#: A quote begins a value only after "=".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body head address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the open element of these, looked for up to the border.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"html", "body", "head", "caption", "dd", "dt", "li", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
#: Never text of a page: not shown, or controls.
UNSEEN = frozenset("head script style noscript template button select option textarea input iframe svg canvas object math title audio video map datalist".split())
#: What these hold inside a region is no article text, unless it is most of it.
APART = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer topbar cookie cookies cookie-notice "
    "consent notice notification popup modal overlay comment comments comment-list replies disqus share sharing social related recommended newsletter subscribe pagination pager".split()
)


def parse(page: str | None) -> tuple[list[int], list[str], list[tuple[int, str]]]:
    """Parents and labels of the block elements (0 is the root), and in page order the blocks of text, each with its element."""
    parents, labels = [-1], [" "]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, unseen
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    page = page or ""

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def pop(to):
        while len(stack) > to:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()

    def end(names, border):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                pop(i)
                return
            if stack[i][0] in border:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not stack[-1][2]:
            held.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        attributes: dict[str, str] = {}
        for k, a, b, c in ATTRIBUTE.findall(m[3]) if m[3].strip() else ():
            attributes.setdefault(k.lower(), a or b or c)
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                end({"p"}, {"article", "div", "td", "th", "section", "table", "button", "body"})
            if tag in ENDS:
                end(*ENDS[tag])
        above = stack[-1]
        unseen = above[2] or tag in UNSEEN or "hidden" in attributes
        element = above[1]
        if tag in BLOCK and not unseen:
            names = sorted({w for w in re.split(r"[\s\d]+", (attributes.get("class", "") + " " + attributes.get("id", "")).lower()) if w})
            element = len(parents)
            parents.append(above[1])
            labels.append(" ".join([tag, "role=" + attributes["role"].strip().lower() if attributes.get("role") else "", *names]))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = page.find(">", close.start()) if close else -1
            at = stop + 1 if stop >= 0 else n
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            if unseen and not above[2] and tag not in BLOCK:
                held.append(" ")
            stack.append((tag, element, unseen))
    pop(1)
    flush()
    return parents, labels, blocks


def skeleton(parents: list[int], labels: list[str]) -> tuple[list[int], list[str], list[int]]:
    """Parents and labels of the slots in preorder, and the slot of each element; runs of equal siblings share a slot."""
    children: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents[1:], 1):
        children[p].append(i)
    known: dict[tuple, int] = {}
    shape = [0] * len(parents)
    for i in range(len(parents) - 1, -1, -1):
        folded: list[int] = []
        for c in children[i]:
            if not folded or folded[-1] != shape[c]:
                folded.append(shape[c])
        shape[i] = known.setdefault((labels[i], *folded), len(known))
    up, names, slots = [], [], [0] * len(parents)
    waiting = [([0], -1)]
    while waiting:
        same, above = waiting.pop()  # elements of one shape
        slot = len(up)
        up.append(above)
        names.append(labels[same[0]])
        runs: list[list[int]] = []
        for node in same:
            slots[node] = slot
            k, last = -1, -1
            for c in children[node]:
                if shape[c] != last:
                    k, last = k + 1, shape[c]
                    if k == len(runs):
                        runs.append([])
                runs[k].append(c)
        waiting.extend((run, slot) for run in reversed(runs))
    return up, names, slots


def _children(up: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in up]
    for i, p in enumerate(up):
        if p >= 0:
            out[p].append(i)
    return out


def tree_match(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> dict[int, int]:
    """Simple tree matching: slots of `a` aligned with slots of `b`, most slots in all, order and parents kept."""
    x, y, la, lb = _children(a[0]), _children(b[0]), a[1], b[1]
    pairs = [(0, 0)] if la[0] == lb[0] else []
    for i, j in pairs:  # grows: all pairs of equal labels whose parents are such a pair
        pairs.extend((p, q) for p in x[i] for q in y[j] if la[p] == lb[q])
    size: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(pairs):
        best = [[0] * (len(y[j]) + 1) for _ in range(len(x[i]) + 1)]
        for p, c in enumerate(x[i], 1):
            row, over = best[p], best[p - 1]
            for q, d in enumerate(y[j], 1):
                row[q] = max(over[q], row[q - 1], over[q - 1] + size.get((c, d), 0))
        size[i, j], tables[i, j] = best[-1][-1] + 1, best
    out, waiting = {}, [(0, 0)] if pairs else []
    while waiting:
        i, j = waiting.pop()
        out[i] = j
        best, p, q = tables[i, j], len(x[i]), len(y[j])
        while p and q:
            w = size.get((x[i][p - 1], y[j][q - 1]), 0)
            if w and best[p][q] == best[p - 1][q - 1] + w:
                waiting.append((x[i][p - 1], y[j][q - 1]))
                p, q = p - 1, q - 1
            elif best[p][q] == best[p - 1][q]:
                p -= 1
            else:
                q -= 1
    return out


def _sums(up: list[int], mass: list[float]) -> list[float]:
    out = list(mass)
    for i in range(len(up) - 1, 0, -1):
        out[up[i]] += out[i]
    return out


def region(up: list[int], labels: list[str], mass: list[float]) -> int:
    """The slot whose subtree is the wrapper's content: from the root down, as long as one child that has parts of its own holds
    half of all varying text. An article ends the way, and so does a part whose own varying headings would be left behind."""
    below, total, at = _children(up), _sums(up, mass), 0
    tag = [x.split(" ", 1)[0] for x in labels]
    while tag[at] != "article":
        if tag[at] not in ("", "html", "body") and any(tag[c] in HEADINGS and total[c] > 0 for c in below[at]):
            break
        best = max(below[at], key=lambda c: total[c], default=-1)
        if best < 0 or not below[best] or total[best] * 2 < total[0] or total[0] <= 0:
            break
        at = best
    return at


def kept_slots(up: list[int], labels: list[str], to: list[int], top: int, home_mass: list[float]) -> list[bool]:
    """Which slots of a page's skeleton are main text: those under a slot aligned with the region `top`, but for parts that stand apart
    by tag, role or class and hold less than half of the region's varying text, and headers but for their headings.

    A page without such a slot is judged as a whole.
    """
    some = top in to
    total, n = _sums(up, home_mass), len(up)
    inside, apart, header = [False] * n, [False] * n, [False] * n
    whole = max((total[i] for i in range(n) if to[i] == top), default=0.0) if some else total[0]
    for i in range(n):
        tag, role, *names = labels[i].split(" ")
        above = up[i]
        inside[i] = (to[i] == top if some else i == 0) or above >= 0 and inside[above]
        begins = inside[i] and (above < 0 or not inside[above])
        marked = tag in APART or role.removeprefix("role=") in ROLES or not CLASSES.isdisjoint(names)
        apart[i] = above >= 0 and apart[above] or marked and not begins and total[i] * 2 < max(whole, 1e-9)
        header[i] = tag == "header" or above >= 0 and header[above] and tag not in HEADINGS
    return [inside[i] and not apart[i] and not header[i] for i in range(n)]


def lone_text(page: str | None) -> list[str]:
    """The main text's blocks of a page without a host."""
    parents, labels, blocks = parse(page)
    up, names, slots = skeleton(parents, labels)
    mass = [0.0] * len(up)
    for e, t in blocks:
        mass[slots[e]] += len(t)
    keep = kept_slots(up, names, list(range(len(up))), region(up, names, mass), mass)
    return [t for e, t in blocks if keep[slots[e]]]


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, host, html) as host, page (hash), shape and blocks (slot, said (hash), text). A page without host is
    a host of its own."""
    ship(pages.sparkSession)

    def rows(batches):
        for b in batches:
            out = []
            for i, url, host, page in zip(b["page_id"], b["url"], b["host"], b["html"], strict=True):
                parents, labels, blocks = parse(page)
                up, names, slots = skeleton(parents, labels)
                key = _key(page)
                found = [{"slot": slots[e], "said": _key(t), "text": t} for e, t in blocks]
                out.append((i, url, host or f" {key}", key, json.dumps([up, names], separators=(",", ":"), ensure_ascii=False), found))
            yield pd.DataFrame(out, columns=["page_id", "url", "host", "page", "shape", "blocks"])

    found = pages.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(rows, "page_id string, url string, host string, page long, shape string, blocks array<struct<slot:int,said:long,text:string>>")
    return written(found.withColumns({"page_id": F.col("page_id").cast("long"), "s": F.xxhash64("shape")}), "parsed-pages", "zstd")


def wrappers(found: DataFrame, share: float, least: int) -> DataFrame:
    """host, s, keep (a flag for each slot), template (slot, said) for every skeleton of `found` (see `parsed_pages`).

    All different pages of a host count. Texts are counted by hash, partially in every task, so that a large host is no
    large group; what comes together is a row for each slot of a reference. Hosts with fewer than `least` different
    pages have no template.
    """
    kinds = found.groupBy("host", "s", "shape").agg(F.count("*").alias("n"))
    kinds = written(kinds, "shapes")
    reference = kinds.groupBy("host").agg(F.max_by("shape", F.struct("n", "s")).alias("reference"))

    @F.pandas_udf("struct<to:array<int>,home:array<int>>")
    def aligned(shape: pd.Series, reference: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(shape, reference, strict=True):
            x = json.loads(a)
            pairs = {i: i for i in range(len(x[0]))} if a == b else tree_match(x, json.loads(b))
            home: list[int] = []
            for i, p in enumerate(x[0]):  # an unaligned slot's text counts for the part around it
                home.append(pairs[i] if i in pairs else home[p] if p >= 0 else 0)
            out.append(([pairs.get(i, -1) for i in range(len(x[0]))], home))
        return pd.DataFrame(out, columns=["to", "home"])

    slots = written(kinds.join(reference, "host").select("host", "s", "shape", "reference", aligned("shape", "reference").alias("a")).select("host", "s", "shape", "reference", "a.*"), "aligned-shapes")
    seen = found.select("host", "s", "page", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), b["said"].alias("said"), F.length(b["text"]).alias("size"))))).alias("x"))
    once = seen.select("host", "s", "page", "x.*").distinct()
    counts = once.groupBy("host", "s", "slot", "said", "size").agg(F.count("*").alias("n"))
    placed = counts.join(slots.select("host", "s", "to", "home"), ["host", "s"]).select("host", F.get("to", "slot").alias("to"), F.get("home", "slot").alias("home"), "said", "size", "n")
    many = placed.groupBy("host", "to", "home", "said", "size").agg(F.sum("n").alias("n"))
    pages = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    met = many.join(pages, "host")
    fixed = (F.col("to") >= 0) & (F.col("pages") >= least) & (F.col("n") >= F.col("pages") * share)
    by_slot = met.groupBy("host", "home").agg(F.sum(F.when(fixed, 0).otherwise(F.col("n") * F.col("size"))).cast("double").alias("mass"), F.collect_set(F.when(fixed, F.struct("to", "said"))).alias("fixed"))
    of_host = by_slot.groupBy("host").agg(F.collect_list(F.struct("home", "mass")).alias("masses"), F.flatten(F.collect_list("fixed")).alias("fixed"))
    table = slots.join(of_host, "host", "left")

    def decide(batches):
        for b in batches:
            out = []
            for host, s, shape, reference, to, home, masses, fixed in zip(*(b[c] for c in ("host", "s", "shape", "reference", "to", "home", "masses", "fixed")), strict=True):
                (up, labels), (ref_up, ref_labels), to = json.loads(shape), json.loads(reference), list(to)
                mass = [0.0] * len(ref_up)
                for m in masses if masses is not None else ():
                    mass[m["home"]] = m["mass"]
                top = region(ref_up, ref_labels, mass)
                own = [0.0] * len(up)
                first: dict[int, int] = {}
                for i, h in enumerate(home):
                    first.setdefault(h, i)
                for h, i in first.items():
                    own[i] = mass[h]
                keep = kept_slots(up, labels, to, top, own)
                back: dict[int, list[int]] = {}
                for i, t in enumerate(to):
                    back.setdefault(t, []).append(i)
                template = [{"slot": i, "said": f["said"]} for f in fixed if f is not None for i in back.get(f["to"], ())] if fixed is not None else []
                out.append((host, s, keep, template))
            yield pd.DataFrame(out, columns=["host", "s", "keep", "template"])

    return written(table.mapInPandas(decide, "host string, s long, keep array<boolean>, template array<struct<slot:int,said:long>>"), "wrappers")


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract_pages(pages: DataFrame, share: float = 0.9, least: int = 3, induce: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of `pages` (page_id, url, html).

    White space inside a block becomes one space, blocks are joined by line feeds. A null or empty html, or one without
    text, gives an empty text. A null url, or one without host, is a host of one page. Repeated rows give repeated rows
    (and count as one page of their host), an empty table an empty result; extra columns are ignored. Elements may be
    nested to any depth. `induce=False` judges every page by itself, without its host.
    """
    host = host_of() if induce else F.lit("")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    found = parsed_pages(own)
    met = found.join(wrappers(found, share, least), ["host", "s"])
    keep = F.filter("blocks", lambda b: F.get("keep", b["slot"]) & ~F.array_contains(F.col("template"), F.struct(b["slot"].alias("slot"), b["said"].alias("said"))))
    text = F.array_join(F.transform(keep, lambda b: b["text"]), "\n")
    return met.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
