import random
import re

import pytest

from strandloom.llm import decontaminate


def words(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for p in [x[i : i + window] for i in range(len(x) - window + 1)] if len(x) >= window else [x] if x else []:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chunk", [50, 1 << 20])
@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_like_brute_force(docs_of, window, chunk):
    rnd = random.Random(window)
    word = lambda: rnd.choice(["The", "a", "b", "ü", "C", "d1", "e"])
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rnd.randrange(14))) for i in range(12)] + [(12, None), (12, text(3)), (13, "!!")]
    docs = [(i, text(rnd.randrange(60)) + " " + (items[i % 12][1] or "")) for i in range(60)]
    df = docs_of(docs)
    got = decontaminate.find(df, df.sparkSession.createDataFrame(items, "item_id long, text string"), window=window, chunk_bytes=chunk).collect()
    for r in got:
        n_hit = sum(s["end"] - s["start"] for s in r.hit_spans)
        assert (r.n_words, n_hit, sorted(r.hit_items)) == brute(dict(docs)[r.doc_id], items, window)


def test_awkward_rows(docs_of, awkward):
    docs = docs_of(awkward, extra=True)
    items = docs.sparkSession.createDataFrame([(1, "lorem"), (None, "ipsum"), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    rows = decontaminate.find(docs, items, keep=docs.columns).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[1].hit_items == [] and by[3].hit_items == ["1"] and by[5].hit_items == ["2"] and [tuple(s) for s in by[5].hit_spans] == [(3, 13)]
    none = docs.sparkSession.createDataFrame([], "item_id long, text string")
    assert all(r.hit_items == [] for r in decontaminate.find(docs, none).collect())
    assert decontaminate.find(docs_of([]), items).count() == 0


def test_many_chunks_write_the_documents_once(spark, monkeypatch):
    """Further chunks store their hits alone, and give what one chunk gives, with other columns kept."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 3 : i * 3 + 60]), f"s{i}") for i in range(100)] + [(None, None, "n"), (7, "w21 w22", None), (7, " ".join(words[:30]), "again")]
    items = [(i, " ".join(words[i * 11 : i * 11 + 14])) for i in range(30)] + [(None, " ".join(words[5:15])), (40, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda chunk: sorted(((r.doc_id, r.text, r["_row"], r.n_words, r.hit_spans, r.hit_items) for r in decontaminate.find(df, bench, keep=("text", "_row"), nulls=True, chunk_bytes=chunk).collect()), key=str)
    whole = rows(1 << 20)
    stored, real = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda d, *a: stored.append(1) or real(d, *a))
    assert rows(200) == whole and len(stored) == 1
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", 0)
    assert rows(200) == whole
    assert sum(bool(r[4]) for r in whole) > 50 and any(None in r[5] for r in whole)
