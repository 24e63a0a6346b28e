"""Benchmark decontamination by template windows.

Tokens are words; numbers, units and names become typed places ("<num>", "<unit>", "<name>"), the others are lower-case
literals. Names of several words are one place, and so are number words ("twenty-one"). The first word of a sentence may be
a name or not, so windows with it stand in both forms. In a run of capitals case tells nothing: there a word is a literal if
the benchmark has it as one, and a name if the benchmark has it as one or not at all. Windows of `window` places of the
benchmark, hashed, are joined with those of the documents. Windows that match at one shift form an alignment; each value of
the benchmark's places stands for the value of the document's that most of its windows say, and windows that say another do
not count. So a question with other numbers or names is found, and loose hits are not.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, text_of, written

#: A word that begins a sentence is one token with what stands before it, so its capital is known to be no sign of a name.
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+|(?:[.!?:]\s+|\n[^\S\n]*)[\"'(«„]?[^\W\d_]\w*|[%$€£°]")
WORD = re.compile(r"\w+$")
#: Names and signs of units.
UNITS = frozenset(
    "% $ € £ ° percent dollar dollars euro euros pound pounds cent cents usd eur gbp mm cm m km mile miles inch inches foot feet yard yards "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs oz ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "kmh mph kph degree degrees celsius fahrenheit watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb".split()
)
#: English number words.
NUMBERS = {
    w: n
    for n, w in [
        *enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()),
        *zip(range(20, 100, 10), "twenty thirty forty fifty sixty seventy eighty ninety".split(), strict=True),
        (100, "hundred"),
        (1_000, "thousand"),
        (1_000_000, "million"),
    ]
}
SIGNS = "%$€£°"
BITS = 22
#: What the low bits of a place's hash say in the scan: begins a sentence or may be a name; in capitals; a number word.
EITHER, LOUD, SPELT = 1, 2, 4
#: So many words in capitals, with no other words between, are a run of capitals.
RUN = 4
CHUNK = 250_000


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) & ~7


_NUM, _UNIT, _NAME = (np.uint64(_hash(p)) for p in ("<num>", "<unit>", "<name>"))
_FLAGS, _EITHER, _LOUD, _SPELT = (np.uint64(f) for f in (EITHER | LOUD | SPELT, EITHER, LOUD, SPELT))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


class _Memory(dict):
    """Hashes and flags of tokens that stand alone, remembered for a task; emptied when full, some 30 MB."""

    def __missing__(self, token):
        if len(self) >= 200_000:
            self.clear()
        plain = token.islower() and token[0].isalpha() and token not in NUMBERS
        self[token] = value = _hash(token) if plain else self.of(token)
        return value

    @staticmethod
    def of(token):
        if token[0].isdigit():
            return int(_NUM)
        if token in SIGNS:
            return int(_UNIT)
        word = WORD.search(token)[0]
        if word.lower() in NUMBERS:
            return int(_NUM) | SPELT
        loud = LOUD if word.isupper() else 0
        if not word[0].isupper():
            return _hash(word)
        return int(_NAME) | loud if word is token or word == token else _hash(word[0].lower() + word[1:]) | EITHER | loud


_hashes = _Memory()


def _plain(token: str) -> str:
    return token if token in SIGNS else WORD.search(token)[0].lower() if not token[0].isdigit() else token


def _one_number(before: str, word: str) -> bool:
    """Whether two number words are one number, as in "twenty-one" and "two hundred", but not in "one two"."""
    a, b = NUMBERS[before], NUMBERS[word]
    return a >= 100 or b >= 100 or (a >= 20 and 0 < b < 10)


def _number(words: list[str]) -> str:
    """The figures of a run of number words."""
    total = part = 0
    for n in map(NUMBERS.__getitem__, words):
        if n >= 1_000:
            total, part = total + max(1, part) * n, 0
        else:
            part = max(1, part) * n if n == 100 else part + n
    return str(total + part)


class Places:
    """The places of whole texts, one after the other: `h` (hash, EITHER in its low bit), `text` (number of its text).

    literals, names: bit tables of the benchmark's words, for runs of capitals; without them, words there are literals.
    """

    def __init__(self, texts: list[str], literals: np.ndarray | None = None, names: np.ndarray | None = None):
        tokens, ends = [], []
        for t in texts:
            tokens += TOKEN.findall("\n" + t)
            ends.append(len(tokens))
        n = len(tokens)
        h = np.array(itemgetter(*tokens)(_hashes) if n > 1 else [_hashes[t] for t in tokens], dtype=np.uint64)
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        follows = np.zeros(n, bool)
        follows[1:] = text[1:] == text[:-1]
        loud = (h & _LOUD) > 0
        if loud.any():
            run = np.cumsum(~((loud | ((h & ~_FLAGS) == _NUM) | ((h & ~_FLAGS) == _UNIT)) & follows))  # a new number where a run ends
            many = np.bincount(run, weights=loud, minlength=int(run[-1]) + 1)
            for i in np.flatnonzero(loud & (many[run] >= RUN)).tolist():
                literal = _hash(_plain(tokens[i]))
                named = names is not None and names[literal >> int(_SHIFT)]
                known = literals is None or literals[literal >> int(_SHIFT)]
                h[i] = (literal | EITHER if named else literal) if known else int(_NAME)
        for i in (np.flatnonzero(h[:-1] & ~_FLAGS == _NUM) + 1).tolist() if n else ():
            if follows[i] and _plain(tokens[i]) in UNITS:  # a unit's name stands after a number
                h[i] = _UNIT
        h &= ~_LOUD
        name, spelt = h == _NAME, (h & _SPELT) > 0
        first = name | ((h & _EITHER) > 0)
        joined = np.zeros(n, bool)
        joined[1:] = follows[1:] & name[1:] & first[:-1]
        h[:-1][joined[1:] & name[1:]] = _NAME
        for i in (np.flatnonzero(follows[1:] & spelt[1:] & spelt[:-1]) + 1).tolist():
            joined[i] = _one_number(_plain(tokens[i - 1]), _plain(tokens[i]))
        h &= ~_SPELT
        self.tokens, self.at = tokens, np.append(np.flatnonzero(~joined), n)
        self.h, self.text = h[~joined], text[~joined]

    def value(self, i: int) -> str:
        """What stands at place i, in lower case; number words as figures."""
        words = [_plain(t) for t in self.tokens[self.at[i] : self.at[i + 1]]]
        return _number(words) if words[0] in NUMBERS else " ".join(words)

    def open(self, i: int) -> bool:
        return self.h[i] in (_NUM, _UNIT, _NAME)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` places along the first axis."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.zeros((n, *h.shape[1:]), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def form_hashes(h: np.ndarray, at: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forms of the windows of `size` places that begin at `at`: a row each of place in `at`, hash, and which places of
    marked words are names. Literals that are not `known` (by place of the text) make no form."""
    places = h[at[:, None] + np.arange(size)]
    odd, literal = (places & _EITHER).astype(bool), known[at[:, None] + np.arange(size)]
    places &= ~_EITHER
    rows, names = np.arange(len(at)), np.zeros((len(at), size), bool)
    for j in np.flatnonzero(odd.any(0)).tolist():
        two = odd[rows, j]
        more = names[two]
        more[:, j] = True
        stay = ~two | literal[rows, j]
        rows, names = np.concatenate([rows[stay], rows[two]]), np.concatenate([names[stay], more])
    chosen = np.where(names, _NAME, places[rows])
    return rows, window_hashes(chosen.T, size)[0] if len(rows) else np.zeros(0, np.int64), names


def agreed(windows: list[dict]) -> list[int]:
    """The places `at` of an alignment's windows (at, slots, said) that agree: each slot stands for the value said at most
    places (the least of equals); windows where it has another are in conflict and do not count."""
    votes: dict[str, Counter] = {}
    for _, slot, value in {(w["at"], *p) for w in windows for p in zip(w["slots"], w["said"], strict=True)}:
        votes.setdefault(slot, Counter())[value] += 1
    best = {slot: min(c, key=lambda v: (-c[v], v)) for slot, c in votes.items()}
    return sorted({w["at"] for w in windows if all(best[s] == v for s, v in zip(w["slots"], w["said"], strict=True))})


def benchmark_windows(benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """item_id, at, size, w, n_windows, slots: the windows of every item, a row for each form; items shorter than a window are
    one window. n_windows counts places, not forms.

    Forms with fewer than half literals are left out, for they match anything, unless the item has no others. Items with
    fewer than `least` places have no windows.
    """
    ship(benchmark.sparkSession)

    def rows(batches):
        for b in batches:
            out = []
            for item, t in zip(b["item_id"], b["text"], strict=True):
                p = Places([t or ""])
                n = len(p.h)
                if n < max(1, least):
                    continue
                size = min(window, n)
                at, w, names = form_hashes(p.h, np.arange(n - size + 1), size, np.ones(n, bool))
                made = [(int(i), int(x), [j for j in range(size) if named[j] or p.open(i + j)]) for i, x, named in zip(at, w, names, strict=True)]
                chosen = [m for m in made if len(m[2]) * 2 <= size] or made
                n_windows = len({i for i, _, _ in chosen})
                out += [(item, i, size, x, n_windows, [p.value(i + j) for j in slots]) for i, x, slots in chosen]
            yield pd.DataFrame(out, columns=["item_id", "at", "size", "w", "n_windows", "slots"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(rows, "item_id long, at int, size int, w long, n_windows int, slots array<string>")


def _table(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[bits] = True
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, share: float = 0.5) -> DataFrame:
    """doc_id, h (hash of the text), item_id, n_windows, n_matched: the items of `benchmark` that a text of `docs` holds.

    An item is held if what agrees in its alignments (see `agreed`) matches at least `share` of its windows. Null and empty
    texts and items hold and match nothing; ties and repeated rows give one row for each text and item; empty tables give an
    empty result. Bit tables of fixed size tell which words occur in the benchmark, as literals and as names, and another
    which windows; only windows made of such words, and of a hash in the last, leave the scan.
    """
    spark = docs.sparkSession
    ship(spark)
    items = written(benchmark_windows(benchmark, window, least), "benchmark-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # `window` different ones at most

    def words(batches):
        for b in batches:
            out = set()
            for t in b["text"]:
                p = Places([t or ""])
                for i, h in enumerate(p.h.tolist()):
                    out.add((0, (h & ~EITHER) >> int(_SHIFT)))
                    if h & EITHER or h == int(_NAME):
                        out.add((0, int(_NAME >> _SHIFT)))
                    if h == int(_NAME):
                        out |= {(1, _hash(w) >> int(_SHIFT)) for w in p.value(i).split()}
            yield pd.DataFrame(sorted(out), columns=["name", "bit"])

    bits = benchmark.select("text").mapInPandas(words, "name int, bit int").distinct().toArrow()  # 2 * 2**BITS at most
    name, bit = bits["name"].to_numpy() > 0, bits["bit"].to_numpy()
    wanted = items.select(F.shiftrightunsigned("w", 64 - BITS).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()  # 2**BITS at most
    shared = spark.sparkContext.broadcast([np.packbits(_table(b)) for b in (bit[~name], bit[name], wanted)])

    def found_in(texts, literals, names, wanted):
        """text, place, size, hash and values of the windows of `texts` that may be the benchmark's."""
        p = Places(texts, literals, names)
        literal, n = literals[p.h >> _SHIFT], len(p.h)
        gaps = np.zeros(n + 1, np.int64)
        np.cumsum(~(literal | ((p.h & _EITHER).astype(bool) & literals[_NAME >> _SHIFT])), out=gaps[1:])
        for size in sizes if n else ():
            inside = np.flatnonzero((gaps[size:] == gaps[:-size]) & (p.text[size - 1 :] == p.text[: n - size + 1])) if n >= size else ()
            for part in (inside[i : i + 1024] for i in range(0, len(inside), 1024)):
                at, w, named = form_hashes(p.h, part, size, literal)
                for r in np.flatnonzero(wanted[w.view(np.uint64) >> _SHIFT]).tolist():
                    i = int(part[at[r]])
                    yield int(p.text[i]), i - int(np.searchsorted(p.text, p.text[i])), size, int(w[r]), [p.value(i + j) for j in range(size) if named[r, j] or p.open(i + j)]

    def rows(batches):
        tables = [np.unpackbits(b).astype(bool) for b in shared.value]
        for b in batches:
            doc, h, texts, out = b["doc_id"].to_numpy(), b["h"].to_numpy(), b["text"].tolist(), []
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):  # texts of about a quarter of a megabyte together
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                out += [(doc[at + k], h[at + k], *r) for k, *r in found_in(texts[at:to], *tables)]
                at = to
            yield pd.DataFrame(out, columns=["doc_id", "h", "pos", "size", "w", "said"])
        _hashes.clear()

    own = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    found = own.mapInPandas(rows, "doc_id string, h long, pos int, size int, w long, said array<string>").withColumn("doc_id", F.col("doc_id").cast("long")) if sizes else spark.createDataFrame([], "doc_id long, h long, pos int, size int, w long, said array<string>")
    hits = written(found.join(items, ["w", "size"]), "benchmark-hits")
    keys = ["doc_id", "h", "item_id", "n_windows"]
    aligned = hits.groupBy(*keys, (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set(F.struct("at", "slots", "said")).alias("windows"))

    def ats(batches):
        for b in batches:
            found = pa.array(map(agreed, b.column("windows").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), found], [*keys, "ats"])

    agree = aligned.select(*keys, "windows").mapInArrow(ats, "doc_id long, h long, item_id long, n_windows int, ats array<int>")
    held = agree.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("n_matched"))
    return held.where(F.col("n_matched") >= F.greatest(F.lit(1), F.ceil(F.col("n_windows") * share))).select("doc_id", "h", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "n_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, whose texts hold no item of `benchmark` (see `contaminated`)."""
    found = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (F.xxhash64(text_of()) == found["_h"]), "left_anti")
