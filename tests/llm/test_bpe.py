import hashlib
import random

import pytest
import tiktoken

from strandloom.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe.public()
    ours = bpe.Encoder(bpe.read_ranks(path), pattern)
    return ours, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ours.v.ranks, special_tokens={})


def texts(seed, n, tokens):
    rnd = random.Random(seed)
    letters = "ab 's\n\tAé漢１2  \r\x1c\x85!?.'lldré́🙂 "
    for i in range(n):
        if i % 2:
            yield "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        else:
            yield b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 8))).decode(errors="ignore")


def test_like_tiktoken(pair):
    ours, theirs = pair
    for t in texts(1, 6000, sorted(ours.v.ranks)):
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t), t
        assert ours.decode(ids) == t.encode()


def test_small_caches_change_nothing(pair):
    ours, theirs = pair
    small = bpe.Encoder(ours.v.ranks, bpe.public()[1], cache=5)
    for t in texts(2, 400, sorted(ours.v.ranks)):
        assert small.encode(t) == theirs.encode_ordinary(t)


def test_append_and_edit_are_exact(pair):
    ours, _ = pair
    rnd = random.Random(3)
    for _ in range(300):
        whole = b""
        p = bpe.Prefixes(ours.v)
        for _ in range(rnd.randint(1, 6)):
            more = bytes(rnd.choice(b"the ing to an ") for _ in range(rnd.randint(0, 9)))
            p.append(more)
            whole += more
        a = rnd.randint(0, len(whole))
        z = rnd.randint(a, len(whole))
        new = bytes(rnd.choice(b"stion ") for _ in range(rnd.randint(0, 4)))
        p.edit(a, z, new)
        whole = whole[:a] + new + whole[z:]
        assert p.tokens() == [ours.v.ranks[x] for x in bpe.merge(whole, ours.v.ranks)]
        assert bpe.Prefixes(ours.v, whole).tokens() == p.tokens()


def test_columns(docs_of, awkward, pair):
    docs = docs_of(awkward, extra=True)
    path, pattern = bpe.public()
    rows = bpe.digests(docs, path, pattern).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    text = {r[0]: r[1] or "" for r in awkward}
    for i, r in by.items():
        ids = pair[1].encode_ordinary(text[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()
    tokens = bpe.encode(docs, path, pattern, keep=("doc_id", "text", "ids"))
    back = bpe.decode(tokens, path, pattern).collect()
    assert sorted((r.doc_id or 0, len(r.bytes)) for r in back) == sorted((i or 0, len((t or "").encode())) for i, t, *_ in awkward)
    assert bpe.digests(docs_of([]), path, pattern).count() == 0


def test_edits_are_encoded_near_the_edit_only(pair):
    ours, _ = pair
    rnd = random.Random(4)
    words = ["the", " of", " tion", " sein", "ando", " 12", "\n"]
    whole = "".join(rnd.choice(words) for _ in range(3000)).encode()
    for at in (0, 10, len(whole) // 2, len(whole) - 3):
        for size, new in ((1, b"x"), (0, b" inserted"), (3, b"")):
            p = bpe.Prefixes(ours.v, whole)
            p.computed = 0
            p.edit(at, at + size, new)
            assert p.data == whole[:at] + new + whole[at + size :]
            assert p.last == bpe.Prefixes(ours.v, p.data).last
            assert p.computed <= len(new) + 3 * ours.v.longest


def test_long_matches(pair):
    ours, theirs = pair
    for t in ("a" * 3000, "x" + " " * 500 + "y", "ab" * 1000 + "!" * 400, "漢" * 300, "é" * 33):
        assert ours.encode(t) == theirs.encode_ordinary(t)
    assert ours.encode("") == []


def test_many_texts_at_once(pair):
    """Cuts by bytes, against the library, over texts with odd letters, contractions and white space side by side."""
    import numpy as np

    ours, theirs = pair
    rnd = random.Random(5)
    parts = ["word", "Été", "l'été", "it's", " ", "  ", "\n", "\n\n", "×", "÷", "ﬀ", "²", "Ω", "Жук", "漢字", " ", " ", "​", "12", "٣", ".", "***", "'", "\x00", "\x1f", "\x7f", "\t", "ŉ", "ǅ", "҂", "̈", "🙂"]
    for _ in range(60):
        texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 12))) for _ in range(40)]
        data = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, data)])
        ids = ours.tokens(np.frombuffer(b"".join(data), np.uint8), offs)
        for t, a, n in zip(texts, ids.start.tolist(), ids.n.tolist()):
            assert ids.values[a : a + n].tolist() == theirs.encode_ordinary(t), t
        assert [bytes(b) for b in ours.decode_all(ids)] == data


def test_every_two_byte_character_is_cut_right(pair):
    ours, theirs = pair
    for lo in range(0x20, 0x800, 32):
        t = " ".join(f"a{chr(c)}b {chr(c)} {chr(c)}." for c in range(lo, lo + 32))
        assert ours.encode(t) == theirs.encode_ordinary(t)
