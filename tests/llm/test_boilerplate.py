import random

import pytest

from strandloom.llm import boilerplate


def brute(rows, ratio, min_pages):
    pages, held = {}, {}
    for _, text, host in rows:
        host = host or ""
        pages[host] = pages.get(host, 0) + 1
        for line in set(text.split("\n")) if text is not None else ():
            if line.strip(" "):
                held[host, line] = held.get((host, line), 0) + 1
    bad = {k for k, n in held.items() if n >= min_pages and n > ratio * pages[k[0]]}
    return {i: None if text is None else "\n".join(x for x in text.split("\n") if (host or "", x) not in bad) for i, text, host in rows}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_like_brute_force(docs_of, broadcast):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        host = rnd.choice(["a"] * 5 + ["b", "c", None])
        rows.append((i, "\n".join(rnd.choice([f"menu {host}", "", " ", "shared", f"line {rnd.randrange(400)}"]) for _ in range(rnd.randrange(8))), host))
    rows.append((300, None, "a"))
    docs = docs_of(rows, extra=True)
    out = boilerplate.drop_boilerplate(docs, ratio=0.2, min_pages=5, broadcast_lines=broadcast)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = out.collect()
    want = brute(rows, 0.2, 5)
    assert {r.doc_id: r.text for r in got} == want
    before = {r[0]: r[1] for r in rows}
    for r in got:
        count = lambda t: 0 if t is None else len(t.split("\n"))
        assert r._n_lines == count(before[r.doc_id])
        if want[r.doc_id]:
            assert r._n_dropped == r._n_lines - count(want[r.doc_id])


def test_hosts_are_judged_alone(docs_of):
    rows = [(i, f"footer\nown {i}", "big") for i in range(20)] + [(100 + i, "footer" if i == 0 else f"x {i}", "other") for i in range(20)]
    got = {r.doc_id: r.text for r in boilerplate.drop_boilerplate(docs_of(rows)).collect()}
    assert got[3] == "own 3" and got[100] == "footer"


def test_awkward_rows(docs_of, awkward):
    rows = boilerplate.drop_boilerplate(docs_of(awkward, extra=True)).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[1]._n_lines == 0 and by[2].text == "" and by[3]._n_dropped == 0
    assert boilerplate.drop_boilerplate(docs_of([])).count() == 0
