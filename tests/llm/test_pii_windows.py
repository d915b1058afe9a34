import random
import re
import time

import pytest

from strandloom.llm import pii


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("joe [ at ] example.com", "email", "joe [ at ] example.com"),
        ("joe ( at ) example.com", "email", "joe ( at ) example.com"),
        ("write to joe at example.com", "email", "joe at example.com"),
        ("call +1 five 5 five 0 one 2 three 4 now", "phone", "+1 five 5 five 0 one 2 three 4"),
        ("we wrote " + "j" * 400 + " [at] " + "x" * 400 + ".com", "email", "j" * 400 + " [at] " + "x" * 400 + ".com"),
    ],
)
@pytest.mark.parametrize("near", ["", " – and more"])
def test_no_disguise_hangs_on_a_mark_nearby(text, kind, source, near):
    base, every = pii.find(text + near)
    assert base[kind] == [] and [text[a:z] for a, z in every[kind]] == [source]


def test_windows_give_what_the_whole_text_gives(monkeypatch):
    rnd = random.Random(7)
    bits = ["joe", "we met", "the", "foo bar", "At", "at", "arroba", "[ at ]", "( AT )", "@", " @ ", "dot", "[.]", "{ dot }", "point", "example", "com", "x.org", ".", "one", "five", "5", "0", "plus", "+1", "oh", "fünf", "4l11", "O1", "–", "​", "　", "а", "１", "192", ",", "-", "(", "\n", "k.b@c.de", "4111 1111", "one two three"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", " ", " ", "  "]) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    got = [pii.find(t) for t in texts]
    assert sum(len(pii.windows(t)) > 1 for t in texts) > 1000
    monkeypatch.setattr(pii, "windows", lambda t: [(0, len(t))])
    for t, found in zip(texts, got):
        assert pii.find(t) == found, t


def test_long_runs_of_marks_are_linear():
    for unit in ("1.", "one 1 ", "1 one.", "a [at] ", "word ", "word at "):
        pii.find(unit * 30_000)


@pytest.mark.parametrize(
    "text, want",
    [
        ("1256.7.3.4 " + "y" * 151 + " @ x", []),
        ("+123456789012345678901 " + "y" * 140 + " @ x", []),
        ("u" + "v" * 200 + "@ex\u0430mple.com", ["email:0:213"]),
    ],
)
def test_nothing_is_cut_out_of_a_longer_run(text, want):
    assert pii.joined(pii.find(text)[1]) == ",".join(want)


#: The chained pattern of an address, as one expression: right, but slow where chains have no at.
CHAIN = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?P<local>[A-Za-z0-9_%+-]+(?:(?:\.|{pii._DOT})[A-Za-z0-9_%+-]+)*)(?P<at>@|{pii._AT})(?P<domain>[A-Za-z0-9-]+(?:(?:\.|{pii._DOT})[A-Za-z0-9-]+)+)(?![A-Za-z0-9])", re.I
)


def test_addresses_are_those_of_the_chained_pattern():
    rnd = random.Random(11)
    bits = ["joe", "a", "x_y", "at", "dot", "@", " @ ", "[at]", "( at )", "[.]", "{dot}", "punkt", "point", ".", "-", "_", "%", "com", "ſ", "K", "(", ")", " ", "  ", "\n", "é", "<@>", "[ dot ]", "arroba", "9", " at ", " dot ", "a.b", "at x.y"]
    hits = 0
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(1, 25)))
        want = [(m.span("local"), m.span("at"), m.span("domain")) for m in CHAIN.finditer(t)]
        assert pii.masked(t) == want, t
        hits += len(want)
    assert hits > 1000


@pytest.mark.parametrize("unit, end", [("a.", " @ x"), ("a dot ", " @ x"), ("v1.2.3.", " [at] x"), ("1(dot)", ""), ("a at ", ""), ("a@b dot c ", ""), ("x dot at ", ""), ("a[.]", "@"), ("one dot ", ""), ("at a dot ", "")])
def test_chains_take_linear_time(unit, end):
    """200 KB of them, in a few CPU seconds at most: quadratic time would be minutes."""
    text = unit * (200_000 // len(unit)) + end
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 4
