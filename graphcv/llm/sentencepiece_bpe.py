"""Exact merge-type encoding by backtracking, and decoding.

The text is cut before every word-start mark that follows another character: no piece of such a vocabulary
crosses that place, so the parts encode alone. In a part, one Aho-Corasick pass gives the longest piece at every
position. Encoding walks left to right with the longest piece; two neighbours are compatible if merging their
joined text anew gives the same two pieces. Where none fits, it backs up, and a bitfield remembers positions from
which no way leads on. A sequence whose neighbours are all compatible is the one that merging produces.
The different parts of many texts take these steps together, an array operation for all of them; long parts go alone.
Parts that hold runs of word-start marks are merged directly, as their pieces share one score.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    import struct

    def varint(i):
        shift = value = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        yield number, value


class _Table:
    """Whole numbers of different non-negative keys, by open addressing; -1 for others."""

    def __init__(self, found: dict[int, int]):
        keys = np.fromiter(found.keys(), np.int64, len(found))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.values[at] = np.fromiter(found.values(), np.int64, len(found))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            met = self.keys[at[left]]
            hit = met == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


class PieceEncoder:
    """Encodes and decodes with the merge-type model file at `path` (identity normalisation, byte fallback, leading mark)."""

    #: Pairs of neighbours remembered for long parts are three times as many at most.
    REMEMBERED = 40_000
    #: Characters of the longest part that is encoded together with others, and of the texts whose parts are.
    TOGETHER, AT_ONCE = 64, 2_000_000

    def __init__(self, path: str):
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
                elif number == 3:
                    spec = dict(_fields(value))
                    if spec.get(2) or spec.get(4, 1):
                        raise ValueError("only identity normalisation that keeps white space is supported")
        kinds = {k for _, _, k in pieces}
        if kinds & {USER, UNUSED} or BYTE not in kinds:
            raise ValueError("only models of normal and byte pieces are supported")
        self.pieces = [p for p, _, _ in pieces]
        self.end = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.id):
            raise ValueError("a piece crosses a word start")
        self.automaton = ahocorasick.Automaton()
        usable, splits = set(), {}
        for p in self.id:
            if self._merged(p) == [p]:  # a piece that merging never makes is never a result
                usable.add(p)
                splits[p] = self.joined if len(p) > 1 else None
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        #: The next shorter usable piece that starts as this one does.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in usable), None) for p in usable}
        self.chars = {p for p in usable if len(p) == 1}
        self.name = {p: f" {self.id[p]}" for p in usable}
        self.names = [f" {i}" for i in range(len(self.pieces))]
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Ids of parts, each after a space, and what a part decodes to where that is not its text: for `digests`.
        self.fresh: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        inside = "".join(re.escape(c) for c in sorted(self.chars - {MARK}))
        self.pattern = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{MARK}{inside}]+")
        self._tables(splits)

    def _tables(self, splits: dict[str, tuple[str, str] | None]) -> None:
        """What `together` looks up: the automaton of the pieces read from their ends, shorter pieces, joins and last merges.

        splits: the two parts that each usable piece is merged from last, None for a character.
        """
        ids, count = self.id, len(self.pieces)
        self.code = np.full(0x110000, -1, np.int32)
        self.code[[ord(c) for c in self.chars]] = np.arange(len(self.chars))
        go: dict[int, int] = {}
        parent, step, piece, depth = [0], [0], [-1], [0]
        for p in splits:
            if not self.chars.issuperset(p):
                continue
            state = 0
            for c in self.code[[ord(c) for c in reversed(p)]].tolist():
                state, at = go.setdefault(state << 16 | c, len(parent)), state
                if state == len(parent):
                    parent.append(at)
                    step.append(c)
                    piece.append(-1)
                    depth.append(depth[at] + 1)
            piece[state] = ids[p]
        fail = [0] * len(parent)
        for t in sorted(range(1, len(parent)), key=depth.__getitem__):
            f, c = parent[t], step[t]
            while f and not fail[t]:
                f = fail[f]
                fail[t] = go.get(f << 16 | c, 0)
            if piece[t] < 0:
                piece[t] = piece[fail[t]]
        self.go, self.fail, self.longest = _Table(go), np.array(fail, np.int64), np.array(piece, np.int32)
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.less = np.full(count, -1, np.int32)
        self.rank, self.left, self.right = (np.full(count, -1, np.int64) for _ in range(3))
        for k, p in enumerate(sorted((p for p in splits if len(p) > 1), key=lambda p: -self.score[p])):
            self.rank[ids[p]] = k
            self.left[ids[p]], self.right[ids[p]] = (ids[x] for x in splits[p])
        for p, q in self.shorter.items():
            self.less[ids[p]] = -1 if q is None else ids[q]
        self.joins = _Table({ids[p[:n]] * count + ids[p[n:]]: int(self.rank[ids[p]]) for p in splits for n in range(1, len(p)) if p[:n] in splits and p[n:] in splits})
        #: Whether each piece is merged after its parts, as `_all_fit` takes for granted. Pieces of marks alone do not come there.
        self.ordered = all(self.rank[ids[x]] < self.rank[ids[p]] for p, xs in splits.items() if xs and p.strip(MARK) for x in xs)

    def _all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of the pieces a and b gives the two again: their merges are undone from the last one, and at no time
        may the two neighbours at the border have a join that comes before the merge which takes one of them."""
        ok, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            joined = self.joins.get(a * len(self.pieces) + b)
            bad = (joined >= 0) & (joined < limit)
            ok[at[bad]] = False
            x, y = self.rank[a], self.rank[b]
            later = x > y
            on = np.flatnonzero(~bad & (later | (y >= 0)))
            at, x, y, a, b, later = at[on], x[on], y[on], a[on], b[on], later[on]
            limit = np.where(later, x, y + 1)  # of equal merges the left one comes first
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def together(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Piece ids of all `texts` one after the other, and where those of each end: `backtrack` for all of them at once.

        texts: none empty, of known characters, none with two marks in a row."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")].astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends, n = (begins + sizes)[order], sizes[order]
        longest, state = np.empty(len(codes), np.int32), np.zeros(len(texts), np.int64)
        for j in range(int(n[0])):  # the last character of each text, the one before it, ...
            k = int(np.searchsorted(-n, -j))
            place = ends[:k] - 1 - j
            c, s, left = codes[place], state[:k], np.arange(k)
            while len(left):
                to = self.go.get(s[left] << 16 | c[left])
                miss = (to < 0) & (s[left] > 0)
                s[left] = np.where(miss, self.fail[s[left]], np.maximum(to, 0))
                left = left[miss]
            longest[place] = self.longest[s]
        done, failed = np.empty(len(codes), np.int32), np.zeros(len(codes) + len(texts), bool)
        depth, at, last, piece = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int32), longest[begins]
        todo = np.arange(len(texts))
        while len(todo):
            p = piece[todo]
            some = p >= 0
            w, p, back = todo[some], p[some], todo[~some]
            to = at[w] + self.size[p]
            ok = ~failed[begins[w] + w + to]
            check = np.flatnonzero(ok & (last[w] >= 0))
            ok[check] = self._all_fit(last[w[check]], p[check])
            v = w[~ok]
            piece[v] = self.less[p[~ok]]
            w, p, to = w[ok], p[ok], to[ok]
            done[begins[w] + depth[w]] = p
            depth[w] += 1
            at[w], last[w] = to, p
            v = w[to < sizes[w]]
            piece[v] = longest[begins[v] + at[v]]
            if len(back):  # nothing leads on from here after any neighbour that can stand before
                if (depth[back] == 0).any():
                    raise ValueError("no encoding")
                failed[begins[back] + back + at[back]] = True
                depth[back] -= 1
                dropped = done[begins[back] + depth[back]]
                at[back] -= self.size[dropped]
                piece[back] = self.less[dropped]
                last[back] = np.where(depth[back] > 0, done[begins[back] + np.maximum(depth[back] - 1, 0)], -1)
            todo = todo[at[todo] < sizes[todo]]
        total = np.cumsum(depth)
        held = np.arange(int(total[-1])) + np.repeat(begins - (total - depth), depth)
        return done[held].tolist(), total.tolist()

    def learn(self, parts: set[str]) -> None:
        """Put the ids of `parts` into `fresh`. What the two calls before met is remembered, other parts are encoded together; long ones
        are left to `_part`."""
        self.older, self.known, self.fresh = self.known, self.fresh, {}
        new = []
        for p in parts:
            r = self.known.get(p) or self.older.get(p)
            if r is not None:
                self.fresh[p] = r
            elif len(p) <= self.TOGETHER:
                if self.ordered and self.chars.issuperset(p) and MARK + MARK not in p:
                    new.append(p)
                else:
                    self.fresh[p] = self._alone(p)
        if new:
            ids, ends = self.together(new)
            names = list(map(self.names.__getitem__, ids))
            for p, a, b in zip(new, [0, *ends], ends):
                self.fresh[p] = "".join(names[a:b])

    def _alone(self, part: str) -> str:
        ids, decoded = self._part(part)
        if decoded is not None and decoded != part.replace(MARK, " "):
            self.decoded[part] = decoded
        return ids

    def _merged(self, text: str) -> list[str]:
        """`text` by merging: the neighbours whose join has the best score first, the leftmost of equals."""
        part, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i):
            j = after[i]
            if j < n and (s := self.score.get(joined := part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, joined))

        for i in range(n):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if not part[i] or not part[j] or after[i] != j or part[i] + part[j] != joined:
                continue
            self.joined = part[i], part[j]
            part[i], part[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _fit(self, a: str, b: str) -> bool:
        if len(self.compatible) >= 3 * self.REMEMBERED:
            self.compatible.clear()
        fits = self.compatible[a, b] = self._merged(a + b) == [a, b]
        return fits

    def backtrack(self, text: str) -> list[str]:
        """Pieces of `text`, whose characters all are in the vocabulary."""
        longest: list[str | None] = [None] * len(text)
        for end, (back, piece) in self.automaton.iter(text):  # a later end is a longer piece
            longest[end - back] = piece
        done, at, n, shorter, compatible, last = [], 0, len(text), self.shorter, self.compatible, None
        failed = bytearray()  # a bit a position, made at the first failure
        piece = longest[0] if n else None
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not (failed and failed[to >> 3] >> (to & 7) & 1):
                    if last is None:
                        break
                    fits = compatible.get((last, piece))
                    if fits or fits is None and self._fit(last, piece):
                        break
                piece = shorter[piece]
            if piece is not None:
                done.append(piece)
                at, last = to, piece
                piece = longest[at] if at < n else None
            elif done:  # nothing leads on from here after any neighbour that can stand before
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                dropped = done.pop()
                at -= len(dropped)
                piece, last = shorter[dropped], done[-1] if done else None
            else:
                raise ValueError("no encoding")
        return done

    def _part(self, part: str) -> tuple[str, str | None]:
        """Ids of a part, each after a space; and what they decode to, None for the part itself."""
        if self.chars.issuperset(part) and MARK + MARK not in part:
            found, name = self.backtrack(part), self.name
            return "".join([name[p] for p in found]), None
        ids: list[int] = []
        if MARK + MARK in part:
            found = self._merged(part)
        else:
            found, run = [], ""
            for c in part:
                if c in self.id:
                    run += c
                else:
                    found += self.backtrack(run) + [c] if run else [c]
                    run = ""
            found += self.backtrack(run) if run else []
        for p in found:
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return "".join(f" {i}" for i in ids), self._joined(ids)

    def _joined(self, ids: list[int]) -> str:
        """Piece texts with spaces for marks; runs of byte pieces as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i != self.end:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """The text in parts that encode alone: words with the marks before them, and runs of characters that the vocabulary lacks."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def forget(self) -> None:
        """Drop what is remembered, at the end of a task."""
        for memory in (self.known, self.older, self.fresh, self.compatible, self.decoded):
            memory.clear()

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        parts = self.parts(text)
        self.learn(set(parts))
        return [int(i) for p in parts for i in (self.fresh.get(p) or self._alone(p)).split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        joined = self._joined(ids)
        return joined[1:] if joined[:1] == " " else joined

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        return next(self.digests([text]))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """`digest` of each text; the parts of some texts are encoded together."""
        held, n = [], 0
        for i, text in enumerate(texts):
            held.append(self.parts(text))
            n += len(text)
            if n >= self.AT_ONCE or i == len(texts) - 1:
                self.learn(set().union(*held))
                yield from map(self._digest, held)
                held, n = [], 0

    def _digest(self, parts: list[str]) -> tuple[int, str, str]:
        found = list(map(self.fresh.get, parts))
        if None in found:
            found = [self._alone(p) if r is None else r for p, r in zip(parts, found, strict=True)]
        ids = "".join([*found, f" {self.end}"])
        decoded = "".join([self.decoded.get(p, p) for p in parts] if self.decoded else parts).replace(MARK, " ")
        decoded = decoded[1:] if decoded[:1] == " " else decoded
        return ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a process and model file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encode every whole `text` with an end id, then decode it.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with `ids` also ids (array of int) and decoded. Null and empty
    texts give the end id alone and an empty decoded text; repeated rows give repeated rows; an empty table gives an
    empty one; other columns of `docs` are ignored. No shuffle: each row is encoded where it is read.
    """
    ship(docs.sparkSession)
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def rows(batches):
        e = encoder(path or model_path())  # found where the task runs
        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            out = pd.DataFrame(list(e.digests(texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            if ids:
                out["ids"] = [e.encode(t) for t in texts]
                out["decoded"] = [e.decode(i) for i in out["ids"]]
            yield out
        e.forget()

    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # pandas has no whole numbers beside nulls
    return named.mapInPandas(rows, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
