"""Byte-level BPE by prefix dynamic programming.

``last[i]`` is the one last token of the encoding of the first i bytes. A token t that ends at i is it if the token
before, ``last[i - len(t)]``, and t stay apart when their bytes are encoded together. The tokens that end at i come from
an automaton over all tokens, the longest first. So bytes can be appended exactly (go on from the last prefix), and an
edit is re-encoded from the edited byte to where last tokens agree with the old ones over the longest token's length.
Each match of the split pattern is encoded separately, without special tokens. Matches that are new to a worker are
encoded many at a time: one step for each prefix length, over all of them, in numpy.

The test of two tokens is the one published with the open-source ``bpe`` crate (github/rust-gems).

A null text is an empty one and has no tokens; repeated rows and ties are encoded each for itself; extra columns are
not read; an empty table gives an empty result. Lone words' results are kept in a table of bounded size, which holds
only time, never results, back.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST_BYTES, U64, documents, eights, held, mix, same_bytes, slices, tidy

#: Matches that a Python worker holds, about 60 bytes each and what their tokens take.
CACHE = 1 << 19
#: Bytes of a match that is encoded together with others, matches of one step, bytes of text (or one longer text) of one batch.
MATCH_BYTES, TOGETHER, TEXT_BYTES = 64, 1 << 14, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: join the neighbours of the lowest rank, leftmost first, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Lists:
    """Many lists of numbers one after the other: ``values``, and how long each list is."""

    def __init__(self, values: np.ndarray, n: np.ndarray):
        self.values, self.n, self.start = values, n, np.cumsum(n) - n

    @classmethod
    def of(cls, lists, kind) -> Lists:
        return cls(np.fromiter(chain.from_iterable(lists), kind), np.fromiter(map(len, lists), np.int64, len(lists)))

    def __getitem__(self, at: np.ndarray) -> Lists:
        n = self.n[at]
        end = np.cumsum(n)
        return Lists(self.values[np.repeat(self.start[at] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)], n)

    def grouped(self, n: np.ndarray) -> Lists:
        """With each ``n`` lists in a row as one."""
        ends = np.concatenate([[0], np.cumsum(self.n)])[np.concatenate([[0], np.cumsum(n)])]
        return Lists(self.values, np.diff(ends))

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.values, other.values]), np.concatenate([self.n, other.n]))


class Automaton:
    """Longest tokens that end at each byte: ``goto`` by state and byte, ``ends`` by state (-1: none)."""

    def __init__(self, tokens: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for token, rank in tokens.items():
            u = 0
            for c in token:
                v = children[u].get(c)
                if v is None:
                    v = children[u][c] = len(children)
                    children.append({})
                    own.append(-1)
                    depth.append(depth[u] + 1)
                u = v
            own[u] = rank
        self.goto = goto = np.zeros((len(children), 256), np.int32)
        self.ends = ends = np.array(own, np.int32)
        fail = np.zeros(len(children), np.int32)
        for c, v in children[0].items():
            goto[0, c] = v
        level = list(children[0].values())
        while level:
            at = np.array(level)
            goto[at] = goto[fail[at]]
            none = at[ends[at] < 0]
            ends[none] = ends[fail[none]]
            edges = [(u, c, v) for u in level for c, v in children[u].items()]
            if edges:
                u, c, v = (np.array(x) for x in zip(*edges))
                fail[v] = goto[u, c]
                goto[u, c] = v
            level = [e[2] for e in edges]


class Vocabulary:
    """Ranks, and for each token that merging can reach its two halves (a single byte has itself)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        size = max(ranks.values(), default=0) + 1
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        reached = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            below = merge_below(token, ranks, rank)
            if len(below) <= 2:
                self.left[rank], self.right[rank] = ranks[below[0]], ranks[below[-1]]
                reached[token] = rank
        self.automaton = Automaton(reached)
        #: Tokens that merging never makes; a match that is one of them still has it.
        self.unreached = {b: i for b, i in ranks.items() if b not in reached}
        self.length = np.zeros(size, np.int64)
        self.shorter = np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        for token, rank in reached.items():
            self.shorter[rank] = next((reached[token[i:]] for i in range(1, len(token)) if token[i:] in reached), -1)
        whole = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    whole[a << 32 | b] = rank
        self._pairs = np.array(sorted(whole), np.int64)
        self._pair_rank = np.array([whole[k] for k in self._pairs.tolist()], np.int64)
        #: Pairs tested before, one at each place; a pair may push another out.
        self._tested, self._apart = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def joined_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, or a large number."""
        key = a << 32 | b
        if not len(self._pairs):
            return np.full(len(key), 1 << 40)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_rank[at], 1 << 40)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of each a and b together gives a and b again."""
        key = a.astype(np.int64) << 32 | b
        place = (key * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & np.int64((1 << 20) - 1)
        new = np.flatnonzero(self._tested[place] != key)
        out = self._apart[place]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            tested = self._test(keys >> 32, keys & 0xFFFFFFFF)
            out[new] = tested[back]
            self._tested[place[new]], self._apart[place[new]] = key[new], out[new]
            # Of two new pairs for one place, either may have been written: both entries come from the same, last write.
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the latest merge on either side of the border, step by step; a merge across the border that would have come earlier parts them."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 39)
        while len(at):
            across = self.joined_rank(a, b) < limit
            out[at[across]] = False
            inner_a, inner_b = self.right[a], self.left[b]
            split_a, split_b = inner_a != a, inner_b != b
            take_a = split_a & ((a > b) | ~split_b)
            go = ~across & (split_a | split_b)
            limit = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, inner_a, a), np.where(take_a, b, inner_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def last_tokens(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``last[i, j]`` of the prefix with i bytes of the j-th string ``data[start[j] : start[j] + n[j]]``; longest strings come first."""
        top, m = int(n[0]), len(n)
        text = data[np.minimum(start + np.arange(top)[:, None], len(data) - 1)]
        last = np.full((top + 1, m), -1, np.int32)
        flat, goto, ends = last.ravel(), self.automaton.goto.ravel(), self.automaton.ends
        state, rows, live = np.zeros(m, np.int64), np.arange(m), m - np.searchsorted(n[::-1], np.arange(top + 1))
        for i in range(1, top + 1):
            state = goto[state[: live[i]] * 256 + text[i - 1, : live[i]]].astype(np.int64)
            t, row = ends[state].astype(np.int64), rows[: live[i]]
            while len(row):
                if (t < 0).any():
                    raise ValueError(f"byte {text[i - 1, row[np.flatnonzero(t < 0)[0]]]} has no token")
                before = flat[(i - self.length[t]) * m + row]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.stay_apart(before[ask], t[ask])
                last[i, row[ok]] = t[ok]
                row, t = row[~ok], self.shorter[t[~ok]]
        return last

    def encode_all(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> Lists:
        """Tokens of strings (not empty), by their prefixes' last tokens."""
        order, ids, counts = np.argsort(-n, kind="stable"), [], []
        for lo in range(0, len(order), TOGETHER):
            part = order[lo : lo + TOGETHER]
            last, at = self.last_tokens(data, start[part], n[part]), n[part]
            row, steps = np.arange(len(at)), []
            count = np.zeros(len(at), np.int64)
            while len(row):
                t = last[at, row]
                steps.append((row, t))
                count[row] += 1
                at = at - self.length[t]
                row, at = row[at > 0], at[at > 0]
            end = np.cumsum(count)
            found = np.empty(int(end[-1]), np.int32)
            for k, (row, t) in enumerate(steps):
                found[end[row] - 1 - k] = t
            ids.append(found)
            counts.append(count)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Lists(np.concatenate(ids), np.concatenate(counts))[back]


def merge_below(piece: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """BPE with merges of ranks under ``limit`` only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Prefixes:
    """Bytes that are encoded prefix by prefix; ``last`` has a token for each prefix, ``computed`` counts how many were worked out."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.computed = vocabulary, b"", [-1], 0
        self.known: dict[tuple[int, int], bool] = {}
        self.append(data)

    def _state(self, at: int) -> int:
        """The automaton's state after the first ``at`` bytes, which the last bytes, as many as a token can have, decide."""
        state, goto = 0, self.v.automaton.goto
        for c in self.data[max(0, at - self.v.longest) : at]:
            state = goto[state, c]
        return state

    def _last(self, i: int, state: int) -> int:
        v, last = self.v, self.last
        t = int(v.automaton.ends[state])
        while t >= 0:
            before = last[i - len(v.bytes[t])]
            if before < 0:
                break
            if (ok := self.known.get((before, t))) is None:
                ok = self.known[before, t] = bool(v.stay_apart(np.array([before]), np.array([t]))[0])
            if ok:
                break
            t = int(v.shorter[t])
        else:
            raise ValueError(f"byte {self.data[i - 1 : i]!r} has no token")
        self.computed += 1
        return t

    def append(self, more: bytes) -> None:
        state, goto = self._state(len(self.data)), self.v.automaton.goto
        self.data += more
        for i in range(len(self.last), len(self.data) + 1):
            state = goto[state, self.data[i - 1]]
            self.last.append(self._last(i, state))

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes start to end. Prefixes up to ``start`` keep their tokens, and so do those after the place where as many in a row as the longest token has bytes got their old ones."""
        old, tail = self.last, self.data[end:]
        self.data, self.last = self.data[:start], old[: start + 1]
        self.append(new)
        base, same, goto = len(self.data), 0, self.v.automaton.goto
        state = self._state(base)
        self.data += tail
        for k in range(1, len(tail) + 1):
            state = goto[state, tail[k - 1]]
            self.last.append(self._last(base + k, state))
            same = same + 1 if self.last[-1] == old[end + k] else 0
            if same >= self.v.longest:
                self.last += old[end + k + 1 :]
                break

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.v.bytes[out[-1]])
        return out[::-1]


# Classes of bytes: letters, digits and other ASCII that is no white space, the two characters that cut, an apostrophe
# (which contractions begin with); 0 is all else.
_LETTER, _DIGIT, _MARK, _SPACE, _LINE, _APOSTROPHE = range(1, 7)
#: First bytes of two-byte letters: U+00C0 to U+023F and U+0400 to U+047F are letters, but for two signs.
_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xC9), 0xD0, 0xD1])
_SIGNS = ((0xC3, 0x97), (0xC3, 0xB7))


def _class(i: int) -> int:
    c = chr(i)
    if i < 0x80 and c.isalnum():
        return _LETTER if c.isalpha() else _DIGIT
    return {" ": _SPACE, "\n": _LINE, "'": _APOSTROPHE}.get(c, _MARK if 0x20 < i < 0x7F else 0)


_CLASS = np.array([_class(i) for i in range(256)], np.uint8)


def classes(data: np.ndarray) -> np.ndarray:
    out, lead = _CLASS[data], _LEADS[data]
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1] & ((data[1:] & 0xC0) == 0x80)
    for a, b in _SIGNS:
        at = np.flatnonzero((data[:-1] == a) & (data[1:] == b))
        lead[at], second[at + 1] = False, False
    out[lead | second] = _LETTER
    return out


class Encoder:
    """Encodes texts; matches of up to 16 bytes are held with their tokens' place in ``ids``, each in one place of a table of ``cache`` places, where a later one may take its place.

    The pattern's matches must be contractions, runs of letters, of digits or of other marks, each with one space before
    it or none, and white space, as those of the public ones.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.v, self.split, self.cache = Vocabulary(ranks), regex.compile(pattern), cache
        size = len(self.v.length)
        self.bytes = Lists.of([self.v.bytes.get(i, b"") for i in range(size)], np.uint8)
        self.names = Lists.of([b"%d," % i for i in range(size)], np.uint8)
        self.forget()

    def forget(self) -> None:
        self.held = np.zeros((3, self.cache), np.uint64)
        self.place = np.zeros(self.cache, np.int64)
        self.ids = Lists(np.zeros(0, np.int32), np.zeros(0, np.int64))

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First bytes of the pattern's matches in texts one after the other.

        No match goes across one space or line end that stands between two characters that are not white space, except
        that it may begin with the space. Pieces between these cuts that hold nothing but letters, digits and marks are
        matched here, by classes of bytes, the others by the pattern itself.
        """
        n = len(data)
        cls = classes(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        solid = (cls != 0) & (cls != _SPACE) & (cls != _LINE)
        cut = np.zeros(n, bool)
        cut[1:-1] = ~solid[1:-1] & (cls[1:-1] != 0) & solid[:-2] & solid[2:] & ~first[1:-2] & ~first[2:-1]
        begin = np.ones(n, bool)
        begin[1:] = cls[1:] != cls[:-1]
        begin[1:][cut[:-1] & (cls[:-1] == _SPACE)] = False
        begin[first[:-1]] = True
        odd = np.flatnonzero(((cls == 0) | (cls == _APOSTROPHE) | (~solid & ~cut)))
        if len(odd):
            edges = np.append(np.flatnonzero(cut | first[:-1]), n)
            piece = np.unique(np.searchsorted(edges, odd, "right"))
            lo, hi = edges[piece - 1], edges[piece]
            inside = np.zeros(n + 1, np.int64)
            inside[lo] += 1
            inside[hi] -= 1
            begin &= np.cumsum(inside[:-1]) == 0
            at, find, raw = [], self.split.findall, data.tobytes()
            for a, z in zip(lo.tolist(), hi.tolist()):
                for m in find(raw[a:z].decode()):
                    at.append(a)
                    a += len(m) if m.isascii() else len(m.encode())
            begin[at] = True
        return np.flatnonzero(begin)

    def encoded(self, data: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
        """(place in ``ids`` of each match, how many there were before); matches of equal bytes are encoded once."""
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        # Keys only propose: what differs in a byte from the first of its key is encoded by itself.
        rest = np.flatnonzero((n != n[first][same]) | ~same_bytes(data, start, start[first][same], np.minimum(n, n[first][same])))
        same[rest] = np.arange(len(first), len(first) + len(rest))
        each = np.concatenate([first, rest])
        start, n, key = start[each], n[each], key[each]
        base, long = len(self.ids.n), n > MATCH_BYTES
        short = np.flatnonzero(~long)
        out = Lists(np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(short):
            out += self.v.encode_all(data, start[short], n[short])
        out += Lists.of([Prefixes(self.v, data[a : a + z].tobytes()).tokens() for a, z in zip(start[long].tolist(), n[long].tolist())], np.int32)
        place = np.empty(len(each), np.int64)
        place[short], place[long] = np.arange(len(short)), np.arange(len(short), len(each))
        if self.v.unreached:
            alone = {}
            for size in set(map(len, self.v.unreached)):
                for i in np.flatnonzero(n == size).tolist():
                    if (rank := self.v.unreached.get(data[start[i] : start[i] + size].tobytes())) is not None:
                        alone[i] = rank
            place[list(alone)] = len(out.n) + np.arange(len(alone))
            out += Lists(np.array(list(alone.values()), np.int32), np.ones(len(alone), np.int64))
        self.ids += out
        return (base + place)[same], base

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> Lists:
        """Tokens of the texts ``data[offs[i] : offs[i + 1]]``."""
        if not len(data):
            return Lists(np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64))
        if len(self.ids.n) > 2 * self.cache:
            self.forget()
        data = np.concatenate([data, np.zeros(MATCH_BYTES + 8, np.uint8)])
        size = int(offs[-1])
        start = self.starts(data[:size], offs)
        n = np.diff(np.append(start, size))
        wide = eights(data)
        one, two = wide[start] & FIRST_BYTES[np.minimum(n, 8)], wide[start + 8] & FIRST_BYTES[np.clip(n - 8, 0, 8)]
        key = mix(one ^ mix(two + n.astype(U64)))
        more = np.flatnonzero(n > 16)
        for at in range(16, MATCH_BYTES, 8):
            more = more[n[more] > at]
            key[more] = mix(key[more] ^ (wide[start[more] + at] & FIRST_BYTES[np.minimum(n[more] - at, 8)]))
        slot = (key % U64(self.cache)).astype(np.int64)
        known = (self.held[0][slot] == one) & (self.held[1][slot] == two) & (self.held[2][slot] == n.astype(U64))
        place, new = self.place[slot], np.flatnonzero(~known)
        if len(new):
            place[new], _ = self.encoded(data, start[new], n[new], key[new])
            hold = new[n[new] <= 16]
            self.place[slot[hold]] = place[hold]
            # Of matches that share a place the last written stays, in all four alike.
            last = self.place[slot[hold]] == place[hold]
            hold = hold[last]
            self.held[0][slot[hold]], self.held[1][slot[hold]], self.held[2][slot[hold]] = one[hold], two[hold], n[hold].astype(U64)
        return self.ids[place].grouped(np.diff(np.searchsorted(start, offs)))

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.tokens(data, np.array([0, len(data)])).values.tolist()

    def spelled(self, ids: Lists) -> list[memoryview]:
        """Ids of each list in decimal, joined by commas."""
        out = self.names[ids.values].grouped(ids.n)
        whole = memoryview(out.values)
        return [whole[a : a + max(n - 1, 0)] for a, n in zip(out.start.tolist(), out.n.tolist())]

    def decode_all(self, ids: Lists) -> list[memoryview]:
        """The bytes that each list of ids stands for."""
        out = self.bytes[ids.values].grouped(ids.n)
        whole = memoryview(out.values)
        return [whole[a : a + n] for a, n in zip(out.start.tolist(), out.n.tolist())]

    def decode(self, ids) -> bytes:
        return bytes(self.decode_all(Lists.of([ids], np.int64))[0])


def encoder(shared) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    (path, pattern, cache), ranks = shared.value
    table, key = held("bpe"), (path, pattern, cache)
    if key not in table:
        table.clear()
        table[key] = Encoder(ranks, pattern, cache)
    return table[key]


def _share(spark, path: str, pattern: str, cache: int = CACHE):
    return spark.sparkContext.broadcast(((path, pattern, cache), read_ranks(path)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids``, the tokens of each text."""
    shared = _share(docs.sparkSession, path, pattern)
    keep = [c for c in keep if c != "ids"]
    name = text if text in keep else "_text"
    src = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches):
        e = encoder(shared)
        for batch in batches:
            for lo, hi, data, offs in slices(batch, name, TEXT_BYTES, "bpe"):
                ids = e.tokens(data, offs)
                part, ends = batch.slice(lo, hi - lo), np.append(ids.start, ids.start[-1] + ids.n[-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.ListArray.from_arrays(ends, pa.array(ids.values, pa.int32()))], names=[*keep, "ids"])

    return src.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``bytes``, the bytes that ``ids`` stand for; null ids have none."""
    shared = _share(tokens.sparkSession, path, pattern)
    src = tokens.select(*keep, F.col(ids).alias("_ids"))
    schema = src.drop("_ids").withColumn("bytes", F.lit(b"")).schema

    def run(batches):
        e = encoder(shared)
        for batch in batches:
            lists = batch.column("_ids")
            out = e.decode_all(Lists(lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(map(bytes, out), pa.binary())], names=[*keep, "bytes"])

    return src.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", cache: int = CACHE) -> DataFrame:
    """n_tokens and hashes of ids and of the bytes decoded from them, without moving the ids to the JVM."""
    shared = _share(docs.sparkSession, path, pattern, cache)

    def run(batches):
        e = encoder(shared)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, data, offs in slices(batch, "text", TEXT_BYTES, "bpe"):
                ids = e.tokens(data, offs)
                n += ids.n.tolist()
                ids_sha += [hashlib.sha256(b).hexdigest() for b in e.spelled(ids)]
                text_sha += [hashlib.sha256(b).hexdigest() for b in e.decode_all(ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op10(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *public())
