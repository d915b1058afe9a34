"""Personal data, also in disguise, with spans of the source text.

Plain identifiers are found in the text as it is. Besides, transducers rewrite homoglyphs, zero-width characters,
spelled digits and at/dot disguises into a normalised text and note for each of its characters the source characters
that it stands for; identifiers found there are mapped back, and those that touch no plain span of their kind are added.

A null text is an empty one and has no spans; a text of any length is handled whole and in linear time; repeated rows
and ties are handled each for itself; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start within a run of digits: the run's first digit would have led to the same match or failure.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain: from each @, the local part backwards and the domain forwards."""
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        seg = text[low:at]
        start = low + len(seg.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return out


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; matches that fail the kind's test are dropped without another try."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].translate(_NOT_DIGITS)
                if 16 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_NOT_DIGITS)) <= 15]
    return out


#: Letters that look like ASCII ones (fixed values): Cyrillic, then Greek.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХУЅІЈаеорсухѕіјԁԛԝһ", "ABEKMHOPCTXYSIJaeopcyxsijdqwh")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικ", "ABEZHIKMNOPTYXovpik"))
_PUNCT = dict.fromkeys("‐‑‒–—―−﹣－", "-") | dict.fromkeys("․。｡．∙", ".") | dict.fromkeys("              　", " ") | dict.fromkeys("​‌‍⁠﻿­᠎", "")
_GLYPHS: dict[str, str] = {}


def glyph(c: str) -> str:
    """What a character that is not ASCII stands for: ASCII text (or none, if it has no width), else itself."""
    if (got := _GLYPHS.get(c)) is None:
        got = _LOOKALIKES.get(c, _PUNCT.get(c))
        if got is None:
            wide = unicodedata.normalize("NFKC", c)
            got = str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else wide if wide.isascii() and len(wide) <= 4 and not wide.isspace() else c
        _GLYPHS[c] = got
    return got


#: Names of the digits 0 to 9 (fixed values); zero has two in English.
_NAMES = ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf")
SPELLED = {w: str(i) for names in _NAMES for i, w in enumerate(names.split())} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_UNIT = rf"(?:{_DIGIT_WORD}|[0-9]+)"
_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|punkt|punto|point|\.)[ ]?[\])}>][ ]?|[ ](?:dot|punkt|punto)[ ])"
_AT = r"(?:[ ]?[\[({<][ ]?(?:at|arroba|arobase|@)[ ]?[\])}>][ ]?|[ ](?:at|arroba|arobase)[ ]|[ ]@[ ]?|@[ ])"
#: What may follow a run of an address: a dot and another run, or an at and a domain. No run can be followed by both.
_RUN = re.compile(r"[A-Za-z0-9_%+-]+", re.I)
_AFTER = re.compile(rf"(?P<dot>\.|{_DOT})(?=[A-Za-z0-9_%+-])|(?P<at>@|{_AT})(?=[A-Za-z0-9-])", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.I)
_BARE_AT = re.compile(r"[ ](?:at|arroba|arobase)[ ]", re.I)
_DOTS = re.compile(rf"\.|{_DOT}", re.I)
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus[ ,]+)?{_UNIT})(?:(?:[ ,.-]{{1,2}}|{_DOT}){_UNIT}){{2,}}(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ ,]+)|(?P<dot>{_DOT})|(?P<word>{_DIGIT_WORD})|(?P<sep>[ ,.-]+)|(?P<digits>[0-9]+)", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]+(?![A-Za-z0-9])")
#: With odd glyphs, letters among digits and spelled runs all that transducers handle, by their own patterns, so that no disguise is missed.
_SIGN = re.compile(rf"{_AT}|{_DOT}", re.I)
_ANY_AT = re.compile(rf"@|{_AT}", re.I)
_SPECIAL = rf"{_DIGIT_WORD}|plus|dot|punkt|punto|point|at|arroba|arobase"
#: The space after a word of ASCII letters that another one follows, none of them part of a disguise: no identifier, plain or disguised, goes over it.
_CUT = re.compile(rf"(?<![^ \t\n\r])(?!(?i:{_SPECIAL})[ ])[A-Za-z]+[ ](?=(?!(?i:{_SPECIAL})[ \t\n\r])[A-Za-z]+[ \t\n\r])")
_ODD = re.compile(r"[^\x00-\x7fÀ-ÿ]")


class Tape:
    """A text whose characters each stand for source characters ``lo[i]`` to ``hi[i]``."""

    def __init__(self, text: str, lo: list[int], hi: list[int]):
        self.text, self.lo, self.hi = text, lo, hi

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace characters start to end by others; edits come in order and don't overlap. Each new character stands for all that were replaced."""
        text, lo, hi, at = [], [], [], 0
        for a, z, new in edits:
            text += [self.text[at:a], new]
            lo += self.lo[at:a] + [self.lo[a]] * len(new)
            hi += self.hi[at:a] + [self.hi[z - 1]] * len(new)
            at = z
        return Tape("".join([*text, self.text[at:]]), lo + self.lo[at:], hi + self.hi[at:])

    def span(self, a: int, z: int) -> tuple[int, int]:
        return self.lo[a], self.hi[z - 1]


def unglyph(tape: Tape) -> Tape:
    edits = []
    for m in _ODD.finditer(tape.text):
        if (g := glyph(m[0])) != m[0]:
            edits.append((m.start(), m.end(), g))
    return tape.rewrite(edits) if edits else tape


def unletter(tape: Tape) -> Tape:
    """O and l among digits."""
    edits = []
    for m in _LETTER_DIGITS.finditer(tape.text):
        edits += [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(m[0]) if c in "OolI"]
    return tape.rewrite(edits) if edits else tape


def words_in(run: re.Match) -> int:
    """Spelled digits of a run."""
    return sum(p.lastgroup == "word" for p in _SPELLED_PART.finditer(run.string, *run.span()))


def unspell(tape: Tape) -> Tape:
    """Runs with spelled digits: each word becomes its digit, what parts them goes; dots stay dots."""
    edits = []
    for m in _SPELLED_RUN.finditer(tape.text):
        if words_in(m) < 2:
            continue
        for p in _SPELLED_PART.finditer(tape.text, *m.span()):
            if p.lastgroup != "digits":
                new = {"plus": "+", "dot": ".", "sep": "." if "." in p[0] else ""}.get(p.lastgroup)
                edits.append((*p.span(), SPELLED[p[0].lower()] if new is None else new))
    return tape.rewrite(edits) if edits else tape


def undot(tape: Tape) -> Tape:
    """Dots in disguise between digits."""
    edits = [(*m.span(), ".") for m in _DIGIT_DOT.finditer(tape.text)]
    return tape.rewrite(edits) if edits else tape


def masked(text: str) -> list[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """Spans of local part, at and domain of addresses, plain or in disguise, leftmost first and without overlap.

    A local part is a chain of runs joined by dots. Runs are taken from the last to the first: each knows where its chain ends, so each
    is looked at once, and a domain is read once, as none goes over the next at.
    """
    runs = [m.span() for m in _RUN.finditer(text)]
    place, ends = {a: i for i, (a, _) in enumerate(runs)}, [None] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        if after := _AFTER.match(text, runs[i][1]):
            if after["dot"]:
                ends[i] = ends[place[after.end()]]
            elif labels := _LABELS.match(text, after.end()):
                ends[i] = (runs[i][1], after.span(), labels.span())
    out, low = [], 0
    for (a, _), end in zip(runs, ends):
        if end and a >= low:
            out.append(((a, end[0]), *end[1:]))
            low = end[2][1]
    return out


def unmask(tape: Tape) -> Tape:
    """Addresses with at/dot disguises. A bare "at" needs a disguised dot or an end of letters too."""
    text = tape.text
    if not _ANY_AT.search(text):
        return tape
    edits = []
    for local, at, domain in masked(text):
        outer, inner = (list(_DOTS.finditer(text, *part)) for part in (local, domain))
        sign, bare = text[slice(*at)], all(d[0] == "." for d in inner)
        if sign == "@" and bare and all(d[0] == "." for d in outer):
            continue
        if bare and _BARE_AT.fullmatch(sign) and not re.search(r"\.[A-Za-z]{2,}$", text[slice(*domain)]):
            continue
        edits += [(*d.span(), ".") for d in outer] + [(*at, "@")] + [(*d.span(), ".") for d in inner]
    return tape.rewrite(edits) if edits else tape


#: Source characters before a mark of disguise that are searched for a cut first; twice as many each time where there is none, so this changes time only.
REACH = 160


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text with marks of disguise, which alone need normalising: from cut to cut, so that they give what the whole text gives."""
    marks = [m.span() for m in _ODD.finditer(text) if glyph(m[0]) != m[0]] + [m.span() for m in _LETTER_DIGITS.finditer(text)] + [m.span() for m in _SIGN.finditer(text)]
    marks = sorted(marks + [m.span() for m in _SPELLED_RUN.finditer(text) if words_in(m) > 1])
    out, low = [], 0
    for a, z in marks:
        if a < low:
            continue
        start, reach = low, REACH
        while a - reach > low:
            if cuts := [m.end() for m in _CUT.finditer(text, a - reach, a)]:
                start = cuts[-1]
                break
            reach *= 2
        else:
            start = max([low, *(m.end() for m in _CUT.finditer(text, low, a))])
        m = _CUT.search(text, z)
        low = m.end() if m else len(text)
        out.append((start, low))
    return out


def disguised(text: str, parts: list[tuple[int, int]] | None = None) -> dict[str, list[tuple[int, int]]]:
    """Source spans of identifiers in the normalised text; ``parts`` of it are normalised, by default those with marks."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for a, z in windows(text) if parts is None else parts:
        tape = unmask(undot(unletter(unspell(unglyph(Tape(text[a:z], list(range(a, z)), list(range(a + 1, z + 1))))))))
        for kind, spans in plain(tape.text).items():
            out[kind] += [tape.span(*s) for s in spans]
    return out


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans with those that normalising adds, by kind, in order."""
    base = plain(text)
    more = disguised(text)
    spans = {}
    for k in KINDS:
        starts, end, new = [a for a, _ in base[k]], 0, []
        for a, z in sorted(set(more[k])):
            # Plain spans don't overlap, so only the last that starts before z can touch this one.
            i = bisect.bisect_left(starts, z)
            if end <= a and (i == 0 or base[k][i - 1][1] <= a):
                new.append((a, z))
                end = z
        spans[k] = sorted(base[k] + new)
    return base, spans


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in KINDS for a, z in spans[k])


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, number of plain spans by kind, their digest, all spans, and how many normalising added."""

    def run(batches):
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for batch in batches:
            column, rows = batch.column("text"), []
            for lo in range(0, batch.num_rows, 256):
                for t in column.slice(lo, 256).to_pylist():
                    base, every = find(t or "")
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(map(len, base.values()))))
            cols = list(zip(*rows)) if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op1(spark, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))
