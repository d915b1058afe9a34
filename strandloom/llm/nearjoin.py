"""Near-duplicates by a chosen-path set similarity join on word shingles.

Each distinct shingle set gets ``T`` minwise values. A tree's root branches a set by a few chosen minwise positions: sets
with the same value at a chosen position share a child node. Nodes with at most ``NODE`` sets are compared exhaustively
on their signatures; larger ones branch again by positions that the node's path chooses, ``DEPTH`` times at most, after
which all sets of a node count as candidates of each other. ``TREES`` independent trees bring the chance to miss a pair
at the threshold to about 1e-4 for pairs in nodes of the last level and far less elsewhere.

Candidates only say which sets to look at together; every link is confirmed on full sets of shingles, which are told apart
by their words themselves. First each set is compared with one that its nodes propose, the smallest id that seems alike,
in stars of about ``STAR`` sets, then each component found so far with another one, ``ROUNDS`` times: a group of n copies takes
work in proportion to n. Last, sets of one candidate group (component of the candidate graph) whose components still
differ are compared pair by pair, in blocks of ``BLOCK``, so that no task holds a whole group and no pair is left out;
blocks of one component alone are not compared. All give spanning forests of links, never all pairs.

Null and empty texts, and texts without words, have no shingles and no links. A text of fewer words than a shingle has
is one shingle. Equal sets are linked. Rows that share an id are one document; a row without an id is linked with
nothing and kept. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.storage import checkpoint_dir

from .common import NOT_SPACE, SEED, U64, Words, counted, documents, mix, slices, stored, tidy, _rng_table
from .graph import components

WORDS, PERCENT = 5, 80
T, TREES, NODE, DEPTH, BLOCK, STAR, ROUNDS = 128, 12, 200, 4, 400, 100, 2
#: Sets whose signatures agree in fewer positions than this share are no candidates (5 deviations under 0.8).
SEEM = 0.62
#: Tasks among which the sets of one node are dealt when nodes are counted.
SALTS = 16
BROADCAST_ROWS = 300_000
_A, _B = _rng_table(21, T) | U64(1), _rng_table(22, T)
_C1, _C2 = (U64(x) for x in _rng_table(23, 2))


def _shingled(n: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the shingles of texts of n words from ``off`` on."""
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[row], np.minimum(n, k)[row]


def _distinct(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], row[new]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the distinct shingles of a slice of texts, by text and hash."""
    row, lo, size = _shingled(np.diff(w.off), w.off[:-1], k)
    h = mix(size.astype(U64) ^ SEED)
    for j in range(k):
        some = size > j
        h[some] = mix(h[some] ^ w.hash[lo[some] + j])
    return _distinct(h, row)


def same_shingles(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the shingle, text of each) of the distinct shingles of some texts. Equal numbers mean equal words, hashes are not used."""
    known: dict[bytes, int] = {}
    words, counts = [], []
    for _, _, data, offs in slices(batch):
        w = Words(data, offs, NOT_SPACE, True)
        text = w.data.tobytes()
        words += [known.setdefault(text[a:z], len(known)) for a, z in zip(w.starts.tolist(), w.ends.tolist())]
        counts.append(np.diff(w.off))
    word, n = np.array(words, np.int64), np.concatenate(counts)
    row, lo, size = _shingled(n, np.cumsum(n) - n, k)
    # 0 stands for the words that a short text lacks.
    name = np.zeros(len(row), np.int64)
    for j in range(k):
        at = np.where(size > j, lo + j, -1)
        name = np.unique(name * (len(known) + 1) + np.where(at >= 0, word[at] + 1, 0), return_inverse=True)[1] if len(word) else name
    return _distinct(name, row)


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit minwise values of the sets that start at ``starts``."""
    out = np.empty((len(starts), T), np.uint32)
    for i in range(T):
        out[:, i] = mix(np.minimum.reduceat((h ^ _B[i]) * _A[i], starts)) >> U64(32)
    return out


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch):
                w = Words(data, offs, NOT_SPACE, True)
                h, row = shingles(w, k)
                n = np.bincount(row, minlength=hi - lo)
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                ids = w.digests(w.off[:-1], w.off[1:]).T
                sig = [None] * (hi - lo)
                if len(some):
                    for at, s in zip(some.tolist(), signatures(h, starts)):
                        sig[at] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(ids[0].astype("<u8").view(np.int64)), pa.array(ids[1].astype("<u8").view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "n", "ha", "hb", "sig"]
                )

    return run


def chosen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, position): positions that each path chooses, each with chance 1 / (0.8 T), one at least."""
    draw = mix(key[:, None] + (np.arange(1, T + 1, dtype=U64) * _C1)[None, :])
    pick = draw < U64(int(2**64 / (0.8 * T)))
    pick[np.arange(len(key)), draw.argmin(1)] = True
    return np.nonzero(pick)


def branch(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of rows with a node and a signature each."""
    nodes, of = np.unique(key, return_inverse=True)
    node, position = chosen(nodes)
    first = np.searchsorted(node, np.arange(len(nodes) + 1))
    n = np.diff(first)[of]
    row = np.repeat(np.arange(len(key)), n)
    at = position[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[of][row]]
    return row, mix((mix(key[row] ^ _C2) + at.astype(U64)) * U64(0x9E3779B97F4A7C15) + sig[row, at])


def _sig(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _branch(batches):
    for batch in batches:
        if batch.num_rows:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(U64)
            row, child = branch(key, _sig(batch.column("sig"), np.uint32, T))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row])], names=["key", "id"])


def _short(batches):
    """Signatures of a byte for each position."""
    for batch in batches:
        sig = _sig(batch.column("sig"), np.uint32, T).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "short"])


def runs(batches, key: str):
    """Batches cut where ``key`` changes: each yields whole groups of rows that come sorted by it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = rest.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, child) of a spanning forest of a symmetric link matrix, each tree from its first row outwards."""
    parent = np.full(len(linked), -1)
    seen = np.zeros(len(linked), bool)
    for i in range(len(linked)):
        if not seen[i]:
            seen[i] = True
            front = np.array([i])
            while len(front):
                reach = linked[front]
                new = np.flatnonzero(reach.any(0) & ~seen)
                parent[new] = front[reach[:, new].argmax(0)]
                seen[new] = True
                front = new
    child = np.flatnonzero(parent >= 0)
    return parent[child], child


def _compare_nodes(batches):
    for table in runs(batches, "key"):
        keys, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
        sig = _sig(table.column("short"), np.uint8, T)
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        a, b, agree = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                s = sig[lo:hi]
                same = np.empty((hi - lo, hi - lo), np.uint8)
                for i in range(hi - lo):
                    same[i] = (s == s[i]).sum(1)
                up, down = forest(same >= SEEM * T)
                a += ids[lo:hi][up].tolist()
                b += ids[lo:hi][down].tolist()
                agree += same[up, down].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], names=["a", "b", "w"])


def intersections(h: np.ndarray, row: np.ndarray, m: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of m sets, from (hash, set) cells."""
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1 if len(h) else np.zeros(0, bool)
    held = shared[col]
    col, row = (np.cumsum(shared) - 1)[col[held]], row[held]
    out = np.zeros((m, m), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [c, c + width])
        cells = np.zeros((m, width), np.float32)
        cells[row[a:z], col[a:z] - c] = 1
        out += cells @ cells.T
    return np.rint(out).astype(np.int64)


def _verify(k: int, percent: int):
    def run(batches):
        for table in runs(batches, "task"):
            task, ids = table.column("task").to_numpy(), table.column("id").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                m = hi - lo
                if m < 2:
                    continue
                part = pa.RecordBatch.from_arrays([table.column("text").slice(lo, m).combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text").slice(lo, m)], names=["text"])
                h, row = same_shingles(part, k)
                n = np.bincount(row, minlength=m)
                both = intersections(h, row, m)
                up, down = forest(100 * both >= percent * (n[:, None] + n[None, :] - both))
                own_ids = ids[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[up], pa.int64()), pa.array(own_ids[down], pa.int64())], names=["a", "b"])

    return run


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b, w): spanning links of sets (id, sig) that seem alike, with the positions in which they agree, or share a node of the last level (w is 0)."""
    spark = sets.sparkSession
    checkpoint_dir(spark)
    roots = F.explode(F.array(*(F.lit(i + 1).cast("long") for i in range(TREES))))
    rows = sets.select(roots.alias("key"), "id", "sig").mapInArrow(tidy(_branch), "key long, id long")
    short = sets.select("id", "sig").mapInArrow(tidy(_short), "id long, short binary")
    salt, salts = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    out, live = None, sets.select("id", "sig")
    for depth in range(1, DEPTH + 1):
        rows = rows.withColumn("salt", salt).checkpoint()
        nodes = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low")).where("c > 1")
        held = rows.join(nodes.select("*", salts.alias("salt")), ["key", "salt"]).checkpoint()
        small = held.where(F.col("c") <= NODE).select("key", "id").join(short, "id").select("key", "id", "short")
        small = small.repartition(F.col("key")).sortWithinPartitions("key", "id")
        found = small.mapInArrow(tidy(_compare_nodes), "a long, b long, w int")
        big = held.where(F.col("c") > NODE)
        if depth == DEPTH:
            found = found.union(big.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"), F.lit(0).alias("w")))
        out = found if out is None else out.union(found)
        if depth == DEPTH:
            break
        # Only sets of big nodes branch on, so each level looks for signatures among those of the one before.
        paths, seen = counted(big.groupBy("id").agg(F.collect_list("key").alias("keys")), "id long, keys array<long>")
        if not seen["rows"]:
            break
        few = seen["rows"] <= BROADCAST_ROWS
        live = live.join(F.broadcast(paths) if few else paths, "id").select("id", "sig", "keys").checkpoint()
        rows = live.select(F.explode("keys").alias("key"), "id", "sig").mapInArrow(tidy(_branch), "key long, id long")
        live = live.select("id", "sig")
    return out.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))


_TASKS = "id long, tasks array<long>"


def _confirmed(texts: DataFrame, tasks: DataFrame, total: int, k: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each task, from rows (id, tasks) with ``total`` tasks in all."""
    few = total <= BROADCAST_ROWS
    met = texts.join(F.broadcast(tasks) if few else tasks, "id").select(F.explode("tasks").alias("task"), "id", "text")
    met = met.repartition(F.col("task")).sortWithinPartitions("task", "id")
    return stored(met.mapInArrow(tidy(_verify(k, percent)), "a long, b long"))


def _stars(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(id, tasks): each component so far is put into one task with a set of another one, the best that nodes propose."""
    a, b = (label.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    known = edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", "w", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")).where("_a <> _b")
    both = known.union(known.select("b", "a", "w", "_b", "_a"))
    # Where sets seem to be linked, the smallest component on the other side, so that many meet at few; else the most alike.
    strong = F.col("w") >= 0.8 * T
    best = both.groupBy("_b").agg(F.max_by(F.struct("a", "b"), F.struct(strong, F.when(strong, -F.col("_a")).otherwise(F.col("w").cast("long")), -F.col("a"), -F.col("b"))).alias("e")).select("e.a", "e.b").checkpoint()
    sizes = best.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("chunks")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = best.join(sizes.select("a", "chunks").distinct(), "a").select(F.col("b").alias("id"), F.xxhash64("a", F.pmod(F.xxhash64("b"), "chunks")).alias("task"))
    hubs = sizes.select(F.col("a").alias("id"), F.xxhash64("a", "chunk").alias("task"))
    return dealt.union(hubs).groupBy("id").agg(F.collect_set("task").alias("tasks"))


def _spread(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined with a stored table of few rows a key: sent to all if it is small, else with each key dealt to ``SALTS`` tasks, as one key may have most rows."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys, how)
    salt, salts = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", salt).join(few.select("*", salts.alias("salt")), [*keys, "salt"], how).drop("salt")


def _blocks(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(id, tasks): tasks in which any two sets of one candidate group meet whose components differ."""
    own = F.coalesce(F.col("_l"), F.col("id")).alias("label")
    rows = groups.select("id", F.col("component").alias("grp")).join(label.select("id", F.col("component").alias("_l")), "id", "left").select("id", "grp", own)
    labels = rows.groupBy("grp", "label").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK
    open_ = labels.groupBy("grp").agg(F.count("*").alias("labels"), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("rest")).where("labels > 1")
    # Small components share blocks, numbered first; a large one has blocks of its own after them.
    first = open_.select("grp", F.ceil(F.col("rest") / BLOCK).alias("shared"))
    before = Window.partitionBy("grp").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    big = labels.where(large).join(first, "grp").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    big = big.withColumn("base", F.col("shared") + F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    ends = first.join(big.groupBy("grp").agg(F.sum("blocks").alias("_own")), "grp", "left").select("grp", "shared", (F.col("shared") + F.coalesce("_own", F.lit(0))).alias("all"))
    placed = _spread(rows, ends.checkpoint(), ["grp"], "inner")
    placed = _spread(placed, big.select("grp", "label", "blocks", "base").checkpoint(), ["grp", "label"], "left")
    block = F.when(F.col("base").isNull(), F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("block", block)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda x: F.when(F.col("base").isNull(), (x != F.col("block")) | (F.col("all") == 1)).otherwise((x < F.col("base")) | (x >= F.col("base") + F.col("blocks"))))
    tasks = F.transform(others, lambda x: F.xxhash64("grp", F.least("block", x), F.greatest("block", x)))
    return placed.select("id", tasks.alias("tasks")).where(F.size("tasks") > 0)


def links(texts: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between sets, from their texts (id, text), that hold them together in their components."""
    edges = candidates(sets).checkpoint()
    seen = edges.select("a").union(edges.select("b")).distinct()
    if seen.count() > BROADCAST_ROWS:
        texts = stored(texts.join(seen.withColumnRenamed("a", "id"), "id"))
    found, label = edges.select("a", "b").where("false"), edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")
    for _ in range(ROUNDS):
        tasks, seen = counted(_stars(edges, label), _TASKS, tasks=F.size("tasks"))
        if not seen["rows"]:
            break
        found = found.union(_confirmed(texts, tasks, seen["tasks"], k, percent))
        label = components(found)
    tasks, seen = counted(_blocks(components(edges.select("a", "b")), label), _TASKS, tasks=F.size("tasks"))
    return found if not seen["rows"] else found.union(_confirmed(texts, tasks, seen["tasks"], k, percent))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of at least ``percent`` % similarity), kept."""
    checkpoint_dir(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = src.mapInArrow(tidy(_sketch(k)), "doc_id long, n long, ha long, hb long, sig binary").checkpoint()
    whole = every.where("n > 0 AND doc_id IS NOT NULL")
    sets = whole.groupBy("ha", "hb", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).select("id", "sig", "ha", "hb", "n").checkpoint()
    linked = links(src.select(F.col("doc_id").alias("id"), "text"), sets, k, percent)
    shared = whole.groupBy("doc_id").agg(F.min("ha").alias("x"), F.max("ha").alias("y")).where("x <> y").select("doc_id")
    if not shared.isEmpty():
        # Texts of one id are one document.
        held = whole.join(shared, "doc_id").join(sets.select("ha", "hb", "n", "id"), ["ha", "hb", "n"])
        linked = linked.union(held.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    found = components(linked)
    classes = sets.join(found, "id", "left").select("ha", "hb", "n", F.coalesce("component", "id").alias("component_id"))
    joined = every.drop("sig").withColumn("_in", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n"))).join(classes.withColumnRenamed("n", "_in"), ["ha", "hb", "_in"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.m)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m)::BIGINT AS component_id, d.doc_id = min(m) AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
