"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of benchmark items (10 words; an item of fewer words is one window). Patterns of one
length form one searcher: a shift table over blocks of two words says how far the search may skip, blocks that end a
pattern (shift 0) select a bucket, a prefix block thins it, and words are compared directly to confirm an occurrence.

Rows of the result are those of the input, in any order. A null or empty text has no words and no hits; null or empty
texts of items give no patterns; an item without an id is searched too, and only its id is missing among the hits;
repeated rows and ties are judged each for itself; other columns of the inputs are not read, or kept where asked for,
but for those named like results.
Patterns are sent to executors in chunks of at most ``chunk_bytes`` of item text, so driver and executors hold one chunk at a
time whatever the benchmark's size. One chunk is one narrow pass over the documents. With more, rows are stored once with
the first chunk's hits, each further chunk reads texts alone and stores its hits alone, and hits are joined at the end. An empty table of documents gives an empty result; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, counted, documents, held, slices, stored, tidy

WINDOW = 10
CHUNK_BYTES = 8 << 20
_STEP = U64(0xC2B2AE3D27D4EB4F)


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), ALNUM, True)
    return [w.word(i) for i in range(len(w.starts))]


def windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``window`` words; of a shorter item, but not an empty one, the whole."""
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def word_hashes(words) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM, False).hash


def blocks(h: np.ndarray, size: int) -> np.ndarray:
    """At i the hash of the ``size`` words that end with word i."""
    if size == 1 or len(h) < 2:
        return h
    out = h.copy()
    out[1:] = h[:-1] * _STEP + h[1:]
    return out


class WuManber:
    """Searcher for patterns that all have ``length`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], length: int):
        self.m, self.b = length, min(2, length)
        self.skip = self.m - self.b + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, tuple[bytes, ...], list]]] = defaultdict(list)
        for words, items in patterns.items():
            blk = blocks(word_hashes(words), self.b).tolist()
            for end in range(self.b - 1, self.m):
                self.shift[blk[end]] = min(self.shift.get(blk[end], self.skip), self.m - 1 - end)
            self.buckets[blk[-1]].append((blk[self.b - 1], words, items))

    def search(self, blk: list[int], lo: int, hi: int, word) -> list[tuple[int, list]]:
        """(first word, items) of each occurrence in words lo to hi; blk: block hashes from word lo on."""
        found, i, n, m = [], self.m - 1, hi - lo, self.m
        shift, skip = self.shift, self.skip
        while i < n:
            s = shift.get(blk[i], skip)
            if s:
                i += s
                continue
            first, at = blk[i - m + self.b], lo + i - m + 1
            for prefix, words, items in self.buckets[blk[i]]:
                if prefix == first and all(word(at + k) == w for k, w in enumerate(words)):
                    found.append((i - m + 1, items))
            i += 1
        return found


def searchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(dict)
    for item, text in items:
        for words in windows(item_words(text), window):
            owners = by_length[len(words)].setdefault(words, [])
            if item not in owners:
                owners.append(item)
    return [WuManber(p, n) for n, p in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pass(shared, window: int):
    key = uuid.uuid4().hex

    def run(batches):
        table = held("decontaminate")
        if key not in table:
            table.clear()
            table[key] = searchers(shared.value, window)
        engines = table[key]
        for batch in batches:
            n_words, spans_out, items_out = [], [], []
            spans_in, items_in = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            for lo, hi, data, offs in slices(batch, table="decontaminate"):
                w = Words(data, offs, ALNUM, True)
                blk = {b: blocks(w.hash, b) for b in {e.b for e in engines}}
                for k in range(hi - lo):
                    a, z = int(w.off[k]), int(w.off[k + 1])
                    lists = {b: x[a:z].tolist() for b, x in blk.items()}
                    spans = [(s["start"], s["end"]) for s in spans_in[lo + k]]
                    items = set(items_in[lo + k])
                    for e in engines:
                        for at, owners in e.search(lists[e.b], a, z, w.word):
                            spans.append((at, at + e.m))
                            items.update(owners)
                    n_words.append(z - a)
                    spans_out.append([{"start": s, "end": e} for s, e in merged(spans)])
                    items_out.append(sorted(items - {None}) + [None] * (None in items))
            names = [f for f in batch.schema.names if f not in ("n_words", "hit_spans", "hit_items")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f) for f in names] + [pa.array(n_words, pa.int64()), pa.array(spans_out, SPANS), pa.array(items_out, pa.list_(pa.string()))],
                names=[*names, "n_words", "hit_spans", "hit_items"],
            )

    return run


def chunks(rows, size: int):
    """Lists of (item, text) with at most ``size`` bytes of text each, or one item that is longer."""
    part, n = [], 0
    for item, text in rows:
        b = len((text or "").encode())
        if part and n + b > size:
            yield part
            part, n = [], 0
        part.append((item, text))
        n += b
    yield part


#: Rows with hits, in all chunks, that may be sent to all tasks.
BROADCAST_HITS = 100_000


def find(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, chunk_bytes=CHUNK_BYTES, keep=(), nulls=False) -> DataFrame:
    """``docs``' id (and the columns ``keep``) with n_words, hit_spans (words, end exclusive, merged), hit_items (as strings; ``nulls``: with a null for items without an id)."""
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("n_words", "hit_spans", "hit_items")]
    out = docs.select(F.col(doc_id), F.col(text).alias("text"), *(c for c in keep if c not in (doc_id, "text"))).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items")
    )
    rows = ((None if r[0] is None else str(r[0]), r[1]) for r in items.select(item_id, item_text).toLocalIterator())
    parts = chunks(rows, chunk_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        out = out.mapInArrow(tidy(_pass(spark.sparkContext.broadcast(first), window)), out.schema)
    else:
        out = _many(out, itertools.chain([first, second], parts), window)
    return out if nulls else out.withColumn("hit_items", F.filter("hit_items", lambda i: i.isNotNull()))


def _combined(batches):
    """Spans and items of a row that several chunks hit."""
    for batch in batches:
        found = batch.column("hits").to_pylist()
        spans = [[{"start": a, "end": z} for a, z in merged([(s["start"], s["end"]) for h in hits for s in h["hit_spans"]])] for hits in found]
        sets = [{i for h in hits for i in h["hit_items"]} for hits in found]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, SPANS), pa.array([sorted(x - {None}) + [None] * (None in x) for x in sets], pa.list_(pa.string()))], names=["row", "hit_spans", "hit_items"])


def _many(out: DataFrame, parts, window: int) -> DataFrame:
    """``find`` for items of several chunks: rows are written once, with numbers, and each further chunk reads texts alone and writes its hits alone, which are joined back at the end."""
    spark, row = out.sparkSession, next(n for n in ("_row" + "_" * i for i in itertools.count()) if n not in out.columns)
    hit, base, hits, total = ["hit_spans", "hit_items"], None, None, 0
    for part in parts:
        shared = spark.sparkContext.broadcast(part)
        search = tidy(_pass(shared, window))
        if base is None:
            numbered = out.select(F.monotonically_increasing_id().alias(row), *(F.col(f"`{c}`") for c in out.columns))
            base = stored(numbered.mapInArrow(search, numbered.schema))
            found = base.where(F.size("hit_spans") > 0).select(F.col(row).alias("row"), *hit)
        else:
            texts = base.select(F.col(row).alias("row"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(dict(out.dtypes)["hit_spans"]).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
            found, seen = counted(texts.mapInArrow(search, texts.schema).where(F.size("hit_spans") > 0).select("row", *hit))
            total += seen["rows"]
        shared.unpersist()
        hits = found if hits is None else hits.union(found)
    total += base.where(F.size("hit_spans") > 0).count()
    whole = hits.groupBy("row").agg(F.collect_list(F.struct(*hit)).alias("hits")).mapInArrow(tidy(_combined), "row long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>")
    whole = whole.withColumnRenamed("row", row)
    both = base.drop(*hit).join(F.broadcast(whole) if total <= BROADCAST_HITS else whole, row, "left")
    return both.select(*(F.coalesce(c, F.array().cast(dict(out.dtypes)[c])).alias(c) if c in hit else F.col(f"`{c}`") for c in out.columns))


def op9(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), nulls=True)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS p FROM bs),
ms AS (SELECT DISTINCT m FROM pat),
ds AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m),
dp AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM ds),
hit AS (SELECT doc_id, dp.m, i, item_id FROM dp JOIN pat ON dp.p = pat.p AND dp.m = pat.m),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
