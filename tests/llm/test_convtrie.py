import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(b"%d:" % len(role) + role + text).digest()


def fmod(a, b):
    return a - b * int(a / b)


def plain(rows):
    """The trie by sets of members of each prefix."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - fmod(c, 5), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        inner = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), sum(n not in inner for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, extra=False, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if extra:
        for c in ("conv", "state", "pos", "depth", "digest", "len", "total", "share", "h", "m"):
            df = df.withColumn(c, F.lit("x"))
    return sorted((tuple(r) for r in convtrie.trie(df).collect()), key=str)


def conversations(n, seed, words=3, top=10):
    rng = np.random.default_rng(seed)
    return [(c, t, ["user", "assistant"][t % 2], f"é{rng.integers(words)}") for c in range(n) for t in range(int(rng.integers(1, top)))]


def test_against_sets_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "PIECE", 3)
    rows = conversations(120, 1)
    assert built(spark, rows, extra=True) == plain(rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "hello" if t == 0 or c % 3 == 0 else f"{c % 7}") for c in range(200) for t in range(3 + c % 3)]
    assert built(spark, rows, parts=5) == plain(rows)


def test_a_conversation_of_most_rows_spans_tasks(spark):
    rows = [(7, t, "user", f"x{t % 5}") for t in range(600)] + [(5, t, "user", f"x{t % 5}") for t in range(300)] + conversations(20, 2)
    rows = [r for r in rows if r[0] not in (5, 7) or r[3][0] == "x"]
    spread = convtrie.states(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert spread.where("conv = 7").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (0, 599, 600)
    assert built(spark, rows) == plain(rows)


def test_nulls_ties_repeats_negative_ids_and_no_turns(spark):
    rows = [(None, 0, "user", "lost"), (10, None, None, None), (10, 0, "user", None), (10, 0, None, "user"), (10, 0, "user", None), (11, 5, "", ""), (11, None, "a", "b"), (-3, 0, "x", "y" * 5000), (-3, 1, "x", "y"), (-1, 0, "x", "y"), (24, 0, "q", "only turn")]
    rows += [(c, 0, "z", "z") for c in (26, 27, 28, 29, 31, 32)]
    got = built(spark, rows)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[3] == 11 for r in got)


def test_empty_table(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "a", "b")]) == []


def test_one_name_of_two_prefixes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BASE", 0)
    monkeypatch.setattr(convtrie, "INVERSE", 0)
    rows = [(5, 0, "u", "a"), (5, 1, "u", "c"), (10, 0, "u", "b"), (10, 1, "u", "c")]
    with pytest.raises(Exception, match="two prefixes have one name"):
        built(spark, rows)
