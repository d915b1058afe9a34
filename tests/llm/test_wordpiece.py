import random

from strandloom.llm import bpe, wordpiece


def brute(word, vocabulary):
    n = i = 0
    while i < len(word):
        size = next((s for s in range(len(word) - i, 0, -1) if word[i : i + s] in vocabulary), 0)
        if not size:
            return 1
        i, n = i + size, n + 1
    return n


def test_small_alphabets_like_greedy_matching():
    rnd = random.Random(1)
    for _ in range(300):
        vocabulary = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        a = wordpiece.Automaton(vocabulary, b"")
        for _ in range(40):
            w = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12)))
            assert a.count(w) == brute(w, vocabulary), (vocabulary, w)


def test_public_vocabulary(docs_of):
    path = bpe.public()[0]
    vocabulary = set(bpe.read_ranks(path))
    texts = ["Les mots été naïve, 漢字 and words", "x" * 300, "a\tb\nc", "the thing https://example.com/a?b=1"]
    rows = wordpiece.token_counts(docs_of(list(enumerate(texts))), path).collect()
    for r in rows:
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(brute(b" " + w, vocabulary) for w in words))


def test_awkward_rows(docs_of, awkward):
    rows = wordpiece.token_counts(docs_of(awkward, extra=True), bpe.public()[0]).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[7].n_words == 0 and by[3].n_words == 80_000
    assert wordpiece.token_counts(docs_of([]), bpe.public()[0]).count() == 0


def test_pieces_marked_inside_words(docs_of):
    """Greedy matching with a mark on all pieces of a word but the first."""
    rnd = random.Random(2)

    def plain(word, first, inner):
        i = n = 0
        while i < len(word):
            size = next((s for s in range(len(word) - i, 0, -1) if word[i : i + s] in (inner if i else first)), 0)
            if not size:
                return 1
            i, n = i + size, n + 1
        return n

    for _ in range(300):
        pieces = {rnd.choice([b"", b"##"]) + bytes(rnd.choice(b"ab#") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 14))}
        # A piece that begins with the mark is one of those inside words.
        a = wordpiece.Automaton(pieces, b"", b"##")
        first, inner = {p for p in pieces if not p.startswith(b"##")}, {p[2:] for p in pieces if p.startswith(b"##")}
        for _ in range(40):
            w = bytes(rnd.choice(b"ab#") for _ in range(rnd.randint(1, 10)))
            assert a.count(w) == plain(w, first, inner), (pieces, w)
    rows = wordpiece.token_counts(docs_of([(1, "play playing xplay ing"), (2, None)]), [b"play", b"##ing", b"in", b"##g"], b"", b"##").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {1: 1 + 2 + 1 + 2, 2: 0}
