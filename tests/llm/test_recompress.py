import hashlib
import random

import pytest

from strandloom.llm import recompress


def brute(docs, window):
    """(n_words, n_removed, kept) by id, for texts in order of ids."""
    seen, out = set(), {}
    for i, text in docs:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 3, 40])
@pytest.mark.parametrize("window", [5, 20])
def test_like_brute_force(docs_of, alphabet, window):
    rnd = random.Random(alphabet * 100 + window)
    word = lambda: f"w{rnd.randrange(alphabet)}é"
    base = [word() for _ in range(150)]
    docs = []
    for i in range(40):
        a = rnd.randrange(len(base))
        docs.append((i, " ".join([word() for _ in range(rnd.randrange(30))] + base[a : a + rnd.randrange(120)] + [word() for _ in range(rnd.randrange(30))])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in recompress.dedup(docs_of(docs), window).collect()}
    assert got == brute(docs, window)


def test_blocks_settle_alike(docs_of, monkeypatch):
    rnd = random.Random(9)
    base = [str(rnd.randrange(5)) for _ in range(300)]
    docs = [(i, " ".join(base[a : a + 80] + [str(rnd.randrange(5)) for _ in range(10)])) for i, a in enumerate(rnd.randrange(200) for _ in range(60))]
    monkeypatch.setattr(recompress, "BROADCAST_MARKS", 0)
    got = {r.doc_id: r.n_removed for r in recompress.dedup(docs_of(docs, parts=7)).collect()}
    assert got == {k: v[1] for k, v in brute(docs, 20).items()}


def test_awkward_rows(docs_of, awkward):
    rows = recompress.dedup(docs_of(awkward, extra=True)).collect()
    assert len(rows) == len(awkward)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_words == 0 and by[2][0].kept == "" and by[4][0].n_removed == 0
    # A repeated row comes after the first one, so all of it goes, as does that of another id.
    assert [r.n_removed for r in by[5]] == [60, 60]
    assert by[3][0].n_words == 80_000 and by[3][0].n_removed > 79_900
    assert recompress.dedup(docs_of([])).count() == 0


def test_digest(docs_of):
    rows = recompress.dedup(docs_of([(1, "a  b\tc")]), whole=False).collect()
    assert rows[0].kept == hashlib.sha256(b"a b c").hexdigest()


def test_words_of_a_regular_build_are_told_apart(docs_of):
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"p{i}" for i in range(19))
    rows = recompress.dedup(docs_of([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")])).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 20}
