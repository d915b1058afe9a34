"""Records of sequence files, and how they are read from lines of bytes.

FASTA: a line that starts with '>' after trimming begins a record; the others are joined. FASTQ: four trimmed non-empty
lines a record; quality is dropped and may have any length. Plain text: a sequence on each line, untrimmed; a blank line
ends the file unless ``stop_at_blank`` is off, which skips it instead.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable, Iterator

TEXT_ID = ">useless"  # id of every plain text record (fixed value)
SUFFIXES = {".fa": "fasta", ".fasta": "fasta", ".fna": "fasta", ".fq": "fastq", ".fastq": "fastq", ".txt": "seqtext", ".seq": "seqtext"}


class Malformed(ValueError):
    pass


def format_of(path: str) -> str:
    """fasta, fastq or seqtext, by suffix; .gz is looked through."""
    base = path[:-3] if path.endswith(".gz") else path
    return SUFFIXES.get(os.path.splitext(base)[1].lower(), "seqtext")


def lines(path: str) -> Iterator[str]:
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="latin-1", newline="\n") as f:
        for line in f:
            yield line.removesuffix("\n")


def fasta(rows: Iterable[str], lenient: bool = False) -> Iterator[tuple[str, str]]:
    head, parts = None, []
    for row in rows:
        row = row.strip()
        if row.startswith(">"):
            if head is not None:
                yield head, "".join(parts)
            head, parts = row, []
        elif row:
            if head is None:
                if lenient:
                    continue
                raise Malformed("a sequence stands before the first header")
            parts.append(row)
    if head is not None:
        yield head, "".join(parts)


def fastq(rows: Iterable[str], lenient: bool = False) -> Iterator[tuple[str, str]]:
    held: list[str] = []
    for row in rows:
        row = row.strip()
        if row:
            held.append(row)
        if len(held) == 4:
            at, plus = held[0].startswith("@"), held[2].startswith("+")
            if not (at or plus if lenient else at and plus):
                raise Malformed(f"not a record: {held[0][:60]!r}")
            yield held[0], held[1]
            held = []
    if held and not lenient:
        raise Malformed(f"{len(held)} lines are left after the last record")


def seqtext(rows: Iterable[str], lenient: bool = False, stop_at_blank: bool = True) -> Iterator[tuple[str, str]]:
    for row in rows:
        if row:
            yield TEXT_ID, row
        elif stop_at_blank:
            return


def read(path: str, kind: str = "auto", lenient: bool = False, stop_at_blank: bool = True) -> Iterator[tuple[str, str]]:
    """(id, sequence) of a file's records, sequences normalised to ACGTN."""
    kind = format_of(path) if kind == "auto" else kind
    rows = lines(path)
    found = seqtext(rows, lenient, stop_at_blank) if kind == "seqtext" else {"fasta": fasta, "fastq": fastq}[kind](rows, lenient)
    keep = {ord(c): c for c in "ACGT"}
    for name, seq in found:
        upper = seq.upper()
        yield name, upper.translate(_Only(keep))


class _Only(dict):
    """Translation that keeps some letters and makes all others N."""

    def __missing__(self, key):
        return "N"
