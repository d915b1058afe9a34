"""Substring dedup by recompression.

A text's words are rewritten in rounds. First, runs of one word become one symbol each; then each round parts all
symbols in two halves by a bit of their name and joins neighbours of different halves (left, right) to one symbol. A name
is a 64-bit fingerprint of what it stands for, so all executors give the same names without a dictionary, and equal
substrings get equal symbols inside, whatever stands around them. Each symbol carries the range of words that it depends
on: where that range occurs again, the symbol does too.

A window of ``WINDOW`` words is filed under the least of the highest symbols whose ranges it holds. Equal windows thus
have equal files. Windows of one text in a row with one symbol make a stretch, and only stretches are shuffled, in packed
blocks. Names only say where to look: what is equal is decided by 128 bits of the SHA-256 of the words themselves.
Stretches under one symbol that are equal as a whole settle all their windows at once; those that differ are compared
window by window. Stretches equal within a block are settled before the shuffle, and of more than two that differ, the
others are marked there for comparing; so a symbol sends two stretches at most from each block, however many texts hold it.

A null or empty text has no words. Ties: a window that occurs twice at one place in the order (id, first word) does not
occur earlier; rows are ordered by id, and where ids repeat or are null, by id (nulls last), then text, then one after
the other. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.storage import checkpoint_dir

from .common import M_WORD, NOT_SPACE, U64, Ranges, Words, documents, mix, slices, tidy, _rng_table
from .nearjoin import runs

WINDOW, ROUNDS, RUN_WORDS, SYMBOL_WORDS = 20, 3, 8, 12
#: Stretches packed at once, bytes of text for each bucket, and marks that may be broadcast.
PACK, BUCKET_BYTES, BROADCAST_MARKS = 400_000, 24 << 20, 1_000_000
_SEEDS = _rng_table(31, 64)
STRETCH = np.dtype([("key", "<u8"), ("sha", "<u8"), ("sha2", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("kind", "u1")])
#: What is shuffled: 32 bits of the key do within a bucket, as stretches that share them by chance are compared by windows.
PACKED = np.dtype([("key", "<u4"), *STRETCH.descr[1:]])
OPEN, DONE, CHECK = 0, 1, 2


class Symbols:
    """Names of symbols in order, the words they cover (beg to end) and the words they depend on (lo to hi)."""

    def __init__(self, name, beg, end, lo, hi):
        self.name, self.beg, self.end, self.lo, self.hi = name, beg, end, lo, hi


def _beside(s: Symbols, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether symbol i and i + 1 are of one text; where the left neighbour's range begins and the right one's ends (beyond the text if there is none)."""
    d = doc[s.beg]
    same = d[1:] == d[:-1]
    left, right = bounds[d] - 1, bounds[d + 1] + 1
    left[1:] = np.where(same, s.lo[:-1], left[1:])
    right[:-1] = np.where(same, s.hi[1:], right[:-1])
    return same, left, right


def join_runs(s: Symbols, doc: np.ndarray, bounds: np.ndarray) -> Symbols:
    """Runs of equal symbols, up to ``RUN_WORDS`` words long, as one symbol each. Members of longer ones stay."""
    n = len(s.name)
    if not n:
        return s
    same, left, right = _beside(s, doc, bounds)
    first = np.ones(n, bool)
    first[1:] = ~(same & (s.name[1:] == s.name[:-1]))
    run = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.append(at[1:], n) - 1
    size = last - at + 1
    words = s.end[last] - s.beg[at]
    short = words <= RUN_WORDS
    lo, hi = np.minimum(s.lo, left), np.maximum(s.hi, right)
    # A member of a long run is known as such from RUN_WORDS words of the run on either side.
    own_lo = np.maximum(lo[at][run], np.minimum(s.lo, s.beg - RUN_WORDS))
    own_hi = np.minimum(hi[last][run], np.maximum(s.hi, s.end + RUN_WORDS))
    out = first | ~short[run]
    one = short[run][out]
    r = run[out]
    name = np.where(one & (size[r] > 1), mix(s.name[out] * U64(0x2545F4914F6CDD1D) + size[r].astype(U64)), s.name[out])
    return Symbols(name, s.beg[out], np.where(one, s.end[last][r], s.end[out]), np.where(one, lo[at][r], own_lo[out]), np.where(one, hi[last][r], own_hi[out]))


def join_pairs(s: Symbols, doc: np.ndarray, bounds: np.ndarray, seed: np.uint64) -> Symbols:
    """Neighbours (left half, right half) of at most ``SYMBOL_WORDS`` words as one symbol each."""
    n = len(s.name)
    if not n:
        return s
    same, left, right = _beside(s, doc, bounds)
    to_right = (mix(s.name ^ seed) & U64(1)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = same & ~to_right[:-1] & to_right[1:] & (s.end[1:] - s.beg[:-1] <= SYMBOL_WORDS)
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    # A symbol that stays alone does so for its right (left half) or left neighbour (right half).
    lo = np.where(pair, s.lo, np.where(to_right, np.minimum(s.lo, left), s.lo))
    hi = np.where(to_right, s.hi, np.maximum(s.hi, right))
    name, end = s.name.copy(), s.end.copy()
    p = np.flatnonzero(pair)
    name[p] = mix(mix(s.name[p] ^ seed) * U64(0x9E3779B97F4A7C15) + s.name[p + 1])
    end[p] = s.end[p + 1]
    hi[p] = s.hi[p + 1]
    keep = ~second
    return Symbols(name[keep], s.beg[keep], end[keep], lo[keep], hi[keep])


def levels(w: Words, doc: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The words themselves, then with runs joined, then after each round of pairs."""
    at = np.arange(len(w.hash))
    out = [Symbols(w.hash, at, at + 1, at, at + 1)]
    out.append(join_runs(out[0], doc, w.off))
    for r in range(rounds):
        out.append(join_pairs(out[-1], doc, w.off, _SEEDS[r]))
    return out


def file_windows(w: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, key, symbol's place) of each window: under which fingerprint it is filed, and which symbol in the slice that is."""
    n_words = np.diff(w.off)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    first = np.ones(len(doc), bool)
    first[max(0, len(doc) - window + 1) :] = False
    first[: max(0, len(doc) - window + 1)] = doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :] if len(doc) >= window else False
    todo = np.flatnonzero(first)
    every = todo
    key, place = np.zeros(len(doc), U64), np.zeros(len(doc), np.int64)
    content = Ranges(w.hash, M_WORD)
    for level, s in reversed(list(enumerate(levels(w, doc, rounds)))):
        if not len(todo):
            break
        a = np.searchsorted(s.lo, todo, "left")
        z = np.searchsorted(s.hi, todo + window, "right")
        some = a < z
        at, a, z = todo[some], a[some], z[some]
        todo = todo[~some]
        used = np.zeros(len(s.name), bool)
        n = z - a
        rank = np.zeros(len(s.name), U64)
        inside = (s.lo >= 0) & (s.hi <= len(doc))
        rank[inside] = mix(content(s.lo[inside], s.hi[inside]) + U64(level))
        best, where = rank[a], a.copy()
        for d in range(1, int(n.max()) if len(n) else 0):
            more = np.flatnonzero(n > d)
            j = a[more] + d
            better = rank[j] < best[more]
            best[more[better]], where[more[better]] = rank[j[better]], j[better]
        del used
        key[at], place[at] = best, where * 64 + level
    return every, key[every], place[every]


def stretches(w: Words, ids: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    at, key, place = file_windows(w, window, rounds)
    if not len(at):
        return np.zeros(0, STRETCH)
    doc = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    out = np.zeros(len(first), STRETCH)
    out["key"] = key[first]
    out["sha"], out["sha2"] = w.digests(at[first], at[last] + window).T
    out["doc"] = ids[doc[at[first]]]
    out["start"] = at[first] - w.off[doc[at[first]]]
    out["n"] = last - first + 1
    return out


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x["start"], x["doc"], x["sha2"], x["sha"], x["key"]))]


def _variants(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key begins, and where a key's next text begins, in sorted stretches."""
    key = np.ones(len(x), bool)
    key[1:] = x["key"][1:] != x["key"][:-1]
    variant = key.copy()
    variant[1:] |= (x["sha"][1:] != x["sha"][:-1]) | (x["sha2"][1:] != x["sha2"][:-1])
    return key, variant


def settle_block(x: np.ndarray) -> np.ndarray:
    """Mark stretches that are equal to an earlier one of the block as done; of each key, leave two different ones open."""
    x = _sorted(x)
    key, variant = _variants(x)
    x["kind"] = np.where(variant, OPEN, DONE)
    nth = np.cumsum(variant)
    nth -= np.repeat(nth[key], np.diff(np.append(np.flatnonzero(key), len(x))))
    x["kind"][variant & (nth > 1)] = CHECK
    return x


def _pack(window: int, buckets: int):
    def flush(parts):
        x = settle_block(np.concatenate(parts))
        where = mix(np.where(x["kind"] == OPEN, x["key"], x["doc"].view(U64)))
        bucket = ((where >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, bucket = x[order], bucket[order]
        x = np.empty(len(own), PACKED)
        for name in STRETCH.names:
            x[name] = own[name] & U64(0xFFFFFFFF) if name == "key" else own[name]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(x)]])
        pairs = [(int(bucket[a]), x[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["bucket", "packed"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            ids = batch.column("_o").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch):
                x = stretches(Words(data, offs, NOT_SPACE, False), ids[lo:hi], window)
                if len(x):
                    parts.append(x)
                    n += len(x)
                if n >= PACK:
                    yield flush(parts)
                    parts, n = [], 0
        if n:
            yield flush(parts)

    return run


def settle(x: np.ndarray) -> np.ndarray:
    """Stretches that repeat (done) or have to be compared (check), from all of a bucket."""
    rest = x[x["kind"] != OPEN]
    x = _sorted(x[x["kind"] == OPEN])
    if not len(x):
        return rest
    key, variant = _variants(x)
    at = np.flatnonzero(key)
    several = np.repeat(np.add.reduceat(variant.astype(int), at) > 1, np.diff(np.append(at, len(x))))
    x["kind"] = np.where(~variant, DONE, np.where(several, CHECK, OPEN))
    return np.concatenate([rest, x[x["kind"] != OPEN]])


def _settle(batches):
    for table in runs(batches, "bucket"):
        bucket, packed = table.column("bucket").to_numpy(), table.column("packed")
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = settle(np.frombuffer(b"".join(packed.slice(a, z - a).to_pylist()), PACKED).copy())
            mark = (x["start"].astype(np.int64) << 16) | (x["n"].astype(np.int64) << 8) | x["kind"]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(mark)], names=["_o", "mark"])


def _windows(window: int):
    """Fingerprints of the windows that are to be compared."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("_o").to_numpy(zero_copy_only=False), batch.column("marks")
            for lo, hi, data, offs in slices(batch):
                w = Words(data, offs, NOT_SPACE, False)
                part = marks.slice(lo, hi - lo)
                m, row = part.flatten().to_numpy(), np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy().astype(int))
                n = (m >> 8) & 255
                start = np.repeat(m >> 16, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                at = w.off[row] + start
                h1, h2 = np.ascontiguousarray(w.digests(at, at + window).T)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[lo:hi][row]), pa.array(start.astype(np.int32))], names=["h1", "h2", "_o", "start"])

    return run


def removed_words(n_words: int, marks: np.ndarray, window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    start, n = marks >> 16, (marks >> 8) & 255
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + n - 1 + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _finish(window: int, whole: bool):
    def run(batches):
        for batch in batches:
            texts, marks = batch.column("text").cast(pa.binary()), batch.column("marks")
            for lo in range(0, batch.num_rows, 256):
                part, n_words, n_removed, kept = batch.slice(lo, 256), [], [], []
                for text, m in zip(texts.slice(lo, 256), marks.slice(lo, 256)):
                    words = (text.as_py() or b"").split()
                    n_words.append(len(words))
                    gone = removed_words(len(words), m.values.to_numpy(), window) if m.is_valid and len(m) else None
                    n_removed.append(0 if gone is None else int(gone.sum()))
                    left = b" ".join(words if gone is None else compress(words, (~gone).tolist()))
                    kept.append(left.decode() if whole else hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and ``_o``, which orders rows and is theirs alone: the id where it can be that."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if src.groupBy("doc_id").count().where("`count` > 1 OR doc_id IS NULL").isEmpty():
        return src.withColumn("_o", F.col("doc_id"))
    return src.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_o", F.monotonically_increasing_id()).checkpoint()


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(_o, mark) of windows of ``docs`` (_o, text) that occur earlier: first window << 16 | number of windows << 8 | 1."""
    spark = docs.sparkSession
    src = docs.select("_o", "text")
    total = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, int(total // BUCKET_BYTES))
    packed = src.mapInArrow(tidy(_pack(window, buckets)), "bucket int, packed binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    marks = packed.mapInArrow(tidy(_settle), "_o long, mark long").checkpoint()
    check = marks.where(F.col("mark").bitwiseAND(3) == CHECK)
    small = check.count() <= BROADCAST_MARKS
    lists = check.groupBy("_o").agg(F.collect_list("mark").alias("marks"))
    held = src.join(F.broadcast(lists) if small else lists, "_o").select("_o", "text", "marks")
    windows = held.mapInArrow(tidy(_windows(window)), "h1 long, h2 long, _o long, start int").checkpoint()
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("_o", "start")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("_o", "start") > F.col("first"))
    one = F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.lit(1 << 8 | DONE))
    return marks.where(F.col("mark").bitwiseAND(3) == DONE).union(later.select("_o", one.alias("mark")))


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the kept words joined by spaces, or with ``whole`` false their SHA-256."""
    if not 2 <= window <= 200:
        raise ValueError("windows have 2 to 200 words")
    checkpoint_dir(docs.sparkSession)
    src = ordered(docs, doc_id, text)
    marks = repeats(src, window).groupBy("_o").agg(F.collect_list("mark").alias("marks"))
    return src.join(marks, "_o", "left").select("doc_id", "text", "marks").mapInArrow(tidy(_finish(window, whole)), "doc_id long, n_words long, n_removed long, kept string")


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), whole=False).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(gone.j) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.j) FILTER (gone.j IS NULL), '') AS k FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
