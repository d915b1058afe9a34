"""The prefix trie of conversations, by smallest-member ownership.

A conversation's path is its sequence of turns; a node is a distinct prefix. The smallest member of a node owns it, and so
all deeper nodes of its own path: each conversation owns a suffix of its path, and each node has one owner. Windows over
the prefixes mark what is owned. Then one group-by of all (conversation, depth) rows by prefix gives each node the sums
over its subtree: tokens of its members' paths from its depth on, less those that they own there (which leaves n - 1
times the tokens of each node below), ends that are leaves and are owned, and owned steps to the next depth, its children.

Prefixes are named by running sums: state' = BASE * state + SHA-256 of the turn, modulo PRIME. Turns of a conversation
are sorted and summed across tasks (a conversation may span many; what each task's first and last conversation sum up to
is added on afterwards), so that no conversation has to fit in a task. A name is trusted only if all rows of its node have
one parent and one last turn; else the job ends with an error.

Nulls: a null turn comes first, a null role or text is empty, rows without a conversation's id are left out. Turns that
tie are ordered by the SHA-256 of role and text; repeated rows are turns of their own. Extra columns are not read. An
empty table has no members and gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefixes").digest(), "big") % PRIME
INVERSE = pow(BASE, -1, PRIME)
ZERO = bytes(16)
#: Heads are at most so many turns, lent by the first conversation of so many.
HEAD, FAMILY = 8, 5
#: Ids that are joined into one piece of text.
PIECE = 4096


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _name(x: int) -> bytes:
    return x.to_bytes(16, "big")


_STATES = "part int, edge boolean, conv long, pos long, state binary, cum long, digest binary, n_bytes long"


def states(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos, state, cum, digest, n_bytes of each turn: its place, the state and the sum of bytes up to and with it."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).where("conv IS NOT NULL")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest")]

    def run(batches):
        part, first, conv = TaskContext.get().partitionId(), True, None
        pos = state = cum = 0
        names = [f.split(" ")[0] for f in _STATES.split(", ")]

        def edge():
            """What a conversation that other tasks may go on with sums up to here."""
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([conv]), pa.array([pos]), pa.array([_name(state)]), pa.array([cum]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], names=names)

        for batch in batches:
            out = []
            for c, _, d, n in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if conv is not None and first:
                        yield edge()
                        first = False
                    conv, pos, state, cum = c, 0, 0, 0
                state, cum = (state * BASE + _int(d)) % PRIME, cum + n
                out.append((pos, _name(state), cum))
                pos += 1
            places, names_, sums = zip(*out) if out else ((), (), ())
            own = [pa.array([part] * len(out), pa.int32()), pa.nulls(len(out), pa.bool_()), batch.column(0), pa.array(places, pa.int64()), pa.array(names_, pa.binary()), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(own, names=names)
        if conv is not None:
            yield edge()

    summed = common.stored(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _STATES))
    # Two rows a task at most: what its first conversation comes to, and its last.
    offsets, before = {}, None
    for e in summed.where("edge IS NOT NULL").select("part", "edge", "conv", "pos", "state", "cum").orderBy("part", F.desc("edge")).collect():
        n, state, cum = e.pos, _int(e.state), e.cum
        if e.edge and before and before[0] == e.conv:
            offsets[e.part] = before
            n, state, cum = n + before[1], (before[2] * pow(BASE, n, PRIME) + state) % PRIME, cum + before[3]
        before = (e.conv, n, state, cum)

    def moved(batches):
        for batch in batches:
            part, _, conv, pos, state, cum, *rest = (x.to_pylist() if i < 6 else x for i, x in enumerate(batch.columns))
            for i, (p, c) in enumerate(zip(part, conv)):
                if p in offsets and offsets[p][0] == c:
                    _, n, s, b = offsets[p]
                    state[i] = _name((s * pow(BASE, pos[i] + 1, PRIME) + _int(state[i])) % PRIME)
                    pos[i], cum[i] = pos[i] + n, cum[i] + b
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(pos, pa.int64()), pa.array(state, pa.binary()), pa.array(cum, pa.int64()), *rest], names=["conv", "pos", "state", "cum", "digest", "n_bytes"])

    kind = "conv long, pos long, state binary, cum long, digest binary, n_bytes long"
    plain = summed.where("edge IS NULL")
    return plain.mapInArrow(moved, kind) if offsets else plain.select("conv", "pos", "state", "cum", "digest", "n_bytes")


_PATHS = "conv long, depth long, state binary, parent binary, digest binary, n_bytes long, cum long, len long, total long"


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation and depth of its rebuilt path, the root included: names of the node and its parent, bytes of its last turn and up to it, length and bytes of the path."""
    rows = states(turns, conv_id, turn, role, text)
    head = F.struct("pos", "state", "cum", "digest", "n_bytes")
    convs = common.stored(rows.groupBy("conv").agg(F.count("*").alias("len"), F.sum("n_bytes").alias("total"), F.array_sort(F.collect_list(F.when(F.col("pos") < HEAD, head))).alias("head")))
    lender = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"), F.col("head").alias("base_head"))
    h = F.crc32(F.col("conv").cast("string")) % (HEAD + 1)
    own = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(lender, "base", "left")
    own = own.withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))))
    zero = F.lit(ZERO)
    state = lambda heads, n: F.when(F.col(n) > 0, F.get(heads, (F.col(n) - 1).cast("int"))["state"]).otherwise(zero)
    cum = lambda heads, n: F.when(F.col(n) > 0, F.get(heads, (F.col(n) - 1).cast("int"))["cum"]).otherwise(F.lit(0).cast("long"))
    more = F.greatest(F.col("len") - F.col("h"), F.lit(0))
    lent = cum("base_head", "m")
    own = common.stored(
        own.select(
            "conv", "h", "m", F.slice("base_head", F.lit(1), F.col("m").cast("int")).alias("lent_head"), state("base_head", "m").alias("lent_state"), lent.alias("lent"), (F.col("m") + more).alias("path"),
            F.when(more > 0, state("head", "h")).alias("gone_state"), F.when(more > 0, cum("head", "h")).alias("gone"),
            (lent + F.when(more > 0, F.col("total") - cum("head", "h")).otherwise(0)).alias("bytes"),
        )
    )
    steps = F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), zero.alias("state"), F.lit(0).cast("long").alias("cum"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))), F.coalesce("lent_head", F.array()))
    top = own.select("conv", steps.alias("s"), "path", "bytes").select("conv", "path", "bytes", "s", F.posexplode("s").alias("d", "x"))
    top = top.select("conv", F.col("d").cast("long").alias("depth"), "x.state", F.when(F.col("d") > 0, F.get("s", F.col("d") - 1)["state"]).alias("parent"), "x.digest", "x.n_bytes", "x.cum", F.col("path").alias("len"), F.col("bytes").alias("total"))
    rest = rows.join(own.where("gone IS NOT NULL").select("conv", "h", "m", "lent_state", "lent", "gone_state", "gone", "path", "bytes"), "conv").where("pos >= h")

    def run(batches):
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            names, parents = [], []
            for pos, state, digest, h, lent, gone in zip(c["pos"], c["state"], c["digest"], c["h"], c["lent_state"], c["gone_state"]):
                x = ((_int(lent) - _int(gone)) * pow(BASE, pos + 1 - h, PRIME) + _int(state)) % PRIME
                names.append(_name(x))
                parents.append(_name((x - _int(digest)) * INVERSE % PRIME))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parents, pa.binary()), *(batch.column(n) for n in ("conv", "depth", "digest", "n_bytes", "cum_", "path", "bytes"))], names=["state", "parent", "conv", "depth", "digest", "n_bytes", "cum", "len", "total"])

    rest = rest.select("pos", "state", "digest", "h", "lent_state", "gone_state", "conv", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "n_bytes", (F.col("lent") + F.col("cum") - F.col("gone")).alias("cum_"), "path", "bytes")
    kind = "state binary, parent binary, conv long, depth long, digest binary, n_bytes long, cum long, len long, total long"
    columns = [c.split(" ")[0] for c in _PATHS.split(", ")]
    return common.stored(top.select(*columns).union(rest.mapInArrow(run, kind).select(*columns)), _PATHS)


def owned(rows: DataFrame) -> DataFrame:
    """The rows (conversation, depth) of ``paths`` whose conversation is the smallest of the node, and whether all its members end there.

    Windows over prefixes, in two levels: of each prefix and share of the conversations, then among the smallest of those. There are
    about as many shares as a share has rows, so that a prefix of all conversations is never one task's.
    """
    shares = int(rows.count() ** 0.5) + 1
    node = ["depth", "state"]
    least = lambda df, keys: df.withColumn("_least", F.min("conv").over(Window.partitionBy(*keys))).withColumn("inner", F.max("inner").over(Window.partitionBy(*keys))).where("conv = _least").drop("_least")
    marked = rows.select("conv", *node, "len", "total", "cum", "n_bytes", (F.col("depth") < F.col("len")).alias("inner"), F.pmod(F.xxhash64("conv"), F.lit(shares)).alias("share"))
    return least(least(marked, [*node, "share"]), node).drop("share")


def ends(rows: DataFrame) -> DataFrame:
    """depth, state, sha: of the ids that end at a node, ascending. Pieces of text are joined first, then hashed one after the other."""
    last = rows.where("depth = len").select("depth", "state", "conv")
    order = [F.asc(c) for c in last.columns]

    def joined(batches):
        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["depth", "state", "first", "text"])

        for batch in batches:
            for *new, conv in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and (new != node or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                node = new
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(batches):
        node, digest, out = None, None, []

        def rows_():
            d, s, h = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s, pa.binary()), pa.array(h)], names=["depth", "state", "sha"])

        for batch in batches:
            for *new, _, text in zip(*(x.to_pylist() for x in batch.columns)):
                if new == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = new, hashlib.sha256()
                digest.update(text.encode())
                if len(out) >= 1000:
                    yield rows_()
                    out = []
        if node:
            out.append((*node, digest.hexdigest()))
            yield rows_()

    pieces = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "depth long, state binary, first long, text string")
    return pieces.repartition("depth", "state").sortWithinPartitions("depth", "state", "first").mapInArrow(hashed, "depth long, state binary, sha string")


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows = paths(turns, conv_id, turn, role, text)
    marks = common.stored(owned(rows))
    # Of each conversation: from which depth on it owns its path, the tokens there, and whether its end is a leaf.
    suffix = marks.groupBy("conv").agg(F.min("depth").alias("from"), F.max(F.col("total") - F.col("cum") + F.col("n_bytes")).alias("kept"), F.max((~F.col("inner")).cast("long")).alias("leaf"))
    here = F.col("total") - F.col("cum") + F.col("n_bytes")
    known = rows.join(suffix, "conv", "left").select(
        "conv", "depth", "state", "parent", "digest", (here - F.least(here, F.coalesce("kept", F.lit(0)))).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.when((F.col("depth") < F.col("len")) & (F.col("depth") + 1 >= F.col("from")), 1).otherwise(0).alias("child"),
    )
    same = (F.min("parent").eqNullSafe(F.max("parent"))) & (F.min("digest") == F.max("digest"))
    nodes = known.groupBy("depth", "state").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.when(same, F.min("parent")).otherwise(F.raise_error(F.lit("two prefixes have one name"))).alias("parent"),
    )
    named = nodes.join(ends(rows), ["depth", "state"], "left")
    parents = marks.select((F.col("depth") + 1).alias("depth"), F.col("state").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = named.join(parents, ["depth", "parent"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(common.sha(b""))).alias("ends_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return trie(common.documents(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))), lambda h, x: CASE WHEN x > 0 THEN xor(h, x - 1) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END), 4294967295)"

ORACLE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'k': k, 'b': strlen(text)}} ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY 1),
g AS (SELECT c, l, c - c % 5 AS base, {_CRC} % 9 AS h FROM o),
r AS (SELECT g.c, list_concat(list_slice(coalesce(b.l, []), 1, g.h), list_slice(g.l, g.h + 1, len(g.l))) AS l FROM g LEFT JOIN o b ON b.c = g.base),
p AS (SELECT c, d, len(l) AS n, sha256(array_to_string(list_transform(list_slice(l, 1, d), lambda x: x.k), ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(list_slice(l, 1, d - 1), lambda x: x.k), ',')) END AS pk, CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM r)),
v AS (SELECT d, k, pk, b, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = p.n), '')) AS e FROM p GROUP BY 1, 2, 3, 4),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
sub AS (SELECT p.d, p.k, sum((v.n - 1) * v.b)::BIGINT AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves FROM v LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k JOIN p ON p.c = v.c AND p.d <= v.d GROUP BY 1, 2)
SELECT v.c AS conv_id, v.d AS depth, up.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, v.e AS ends_sha256
FROM v JOIN sub ON sub.d = v.d AND sub.k = v.k LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k LEFT JOIN v up ON up.d = v.d - 1 AND up.k = v.pk"""
