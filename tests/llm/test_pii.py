import hashlib
import random
import re

import pytest

from strandloom.llm import pii


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15],
    }


def test_plain_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    for _ in range(5000):
        t = "".join(rnd.choice(["1", "22", "300", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "0", "é"]) for _ in range(rnd.randint(0, 30)))
        assert pii.plain(t) == brute(t), t


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to john.doe at example dot com today", "email", "john.doe at example dot com"),
        ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("j dot doe(at)mail(dot)example(dot)org", "email", "j dot doe(at)mail(dot)example(dot)org"),
        ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("é ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ é", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("at one nine two dot one six eight dot zero dot one now", "ip", "one nine two dot one six eight dot zero dot one"),
        ("four one one one one one one one one one one one one one one one one".replace("four one one", "four one", 1), "card", "four one one one one one one one one one one one one one one one"),
        ("4l11 1111 1111 1111", "card", "4l11 1111 1111 1111"),
        ("192​.168.1.1", "ip", "192​.168.1.1"),
        ("from 192[.]168[.]1[.]10 on", "ip", "192[.]168[.]1[.]10"),
        ("192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"),
        ("call +1 five five five 012 3456", "phone", "+1 five five five 012 3456"),
        ("john[@]example[.]com", "email", "john[@]example[.]com"),
        ("JOHN AT EXAMPLE DOT COM", "email", "JOHN AT EXAMPLE DOT COM"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, every = pii.find(text)
    assert base[kind] == [] and [text[a:z] for a, z in every[kind]] == [source]


@pytest.mark.parametrize("text", ["we met at home. Then left", "the cat sat at noon.", "one or two of three", "at the dot on the map", "un deux trois", "Ou et de"])
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_base_spans_stay():
    text = "a.b@c.de and a.b at c dot de, 10.0.0.1"
    base, every = pii.find(text)
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
    assert [text[a:z] for a, z in every["email"]] == ["a.b@c.de", "a.b at c dot de"]


def test_awkward_rows(docs_of, awkward):
    rows = pii.spans(docs_of(awkward, extra=True)).collect()
    assert len(rows) == len(awkward)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == none and r.spans == "" for r in rows)
    assert pii.spans(docs_of([])).count() == 0


def test_long_runs_are_linear():
    for unit in ("a", "1", "1.", "a@", "+1 ", "one ", "1 "):
        pii.find(unit * 60_000)
