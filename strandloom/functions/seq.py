"""Sequence, k-mer and codec functions as Column expressions.

All take and return Columns (a str names a column), run in the JVM and give null for null. Where the semantics need an
error (a letter outside ACGT, k over 31), ``raise_error`` ends the query unless ``lenient`` turns it into null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in the order of their codes (fixed values): k-mer codes 0-3, packed bytes 0-3, positional base 64.
CODE_ORDER, PACK_ORDER = "CTAG", "ATCG"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Offset and prime of 32-bit FNV-1a (fixed values).
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
MAX_CODE_K = 31


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def normalize_sequence(seq) -> Column:
    """Upper case; whatever is not A, C, G or T becomes N."""
    return F.regexp_replace(F.translate(_c(seq), "acgt", "ACGT"), "[^ACGT]", "N")


def _must(ok: Column, message: str, value: Column, lenient: bool) -> Column:
    otherwise = F.lit(None) if lenient else F.raise_error(F.lit(message))
    return F.when(ok, value).otherwise(otherwise)


def reverse_complement(seq, checked: bool = False) -> Column:
    """Reversed with A-T and C-G swapped; N stays. With ``checked``, another letter is an error."""
    seq = _c(seq)
    out = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    return F.when(seq.isNull(), None).otherwise(_must(~seq.rlike("[^ACGTN]"), "not a sequence of ACGTN", out, False)) if checked else out


def canonical_kmer(seq) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(_c(seq), reverse_complement(seq))


def _kmers(seq: Column, k: int, gap: str) -> Column:
    parts = F.filter(F.split(seq, gap), lambda x: F.length(x) >= k)
    return F.flatten(F.transform(parts, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (k - 1)), lambda i: F.substring(x, i, k))))


def kmers_forward(seq, k: int, canonical: bool = True, gap: str = "N") -> Column:
    """k-mers of the forward strand in order, with repeats; those of all gap-free segments in one array."""
    out = _kmers(_c(seq), k, gap)
    return F.transform(out, lambda x: canonical_kmer(x)) if canonical else out


def kmers_both_strands(seq, k: int, canonical: bool = True, gap: str = "N") -> Column:
    """Distinct k-mers of both strands."""
    seq = _c(seq)
    forward = kmers_forward(seq, k, canonical, gap)
    # A canonical k-mer is the same on either strand.
    return F.array_distinct(forward if canonical else F.concat(forward, _kmers(reverse_complement(seq), k, gap)))


def kmer_to_number(kmer, lenient: bool = False) -> Column:
    """Base-4 number of a k-mer, first letter highest, C 0, T 1, A 2, G 3; k is at most 31."""
    kmer = _c(kmer)
    value = F.conv(F.translate(kmer, CODE_ORDER, "0123"), 4, 10).cast("long")
    ok = (F.length(kmer) <= MAX_CODE_K) & kmer.rlike("^[ACGT]+$")
    return F.when(kmer.isNull(), None).otherwise(_must(ok, f"k-mers have 1 to {MAX_CODE_K} letters of ACGT", value, lenient))


def number_to_kmer(number, k: int) -> Column:
    """The k-mer of a number."""
    if not 1 <= k <= MAX_CODE_K:
        raise ValueError(f"k is 1 to {MAX_CODE_K}")
    digits = F.lpad(F.conv(_c(number).cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", CODE_ORDER)


def kmer_numbers(seq, k: int, canonical: bool = True, gap: str = "N") -> Column:
    """Numbers of the distinct k-mers of both strands."""
    return F.transform(kmers_both_strands(seq, k, canonical, gap), lambda x: kmer_to_number(x))


def random_kmer(seq, k: int, draw, flip=None) -> Column:
    """A k-mer at ``draw`` (in [0, 1)) of the starts 0 to length - k - 1; where ``flip`` is true, its reverse complement."""
    seq = _c(seq)
    start = F.floor(_c(draw) * (F.length(seq) - k)).cast("int")
    kmer = F.when(F.length(seq) > k, F.substring(seq, start + 1, F.lit(k)))
    return kmer if flip is None else F.when(_c(flip), reverse_complement(kmer)).otherwise(kmer)


def _bytes(text: Column) -> Column:
    """Signed bytes of a text as an array of longs."""
    code = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    unsigned = F.transform(at, lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("long"))
    return F.transform(unsigned, lambda b: F.when(b >= 128, b - 256).otherwise(b))


def fnv1a(text) -> Column:
    """32-bit FNV-1a over signed bytes; of a number, over its decimal digits."""
    return F.aggregate(_bytes(_c(text).cast("string")), _long(FNV_OFFSET), lambda h, b: (h.bitwiseXOR(b.bitwiseAND(_long(MASK32))) * FNV_PRIME).bitwiseAND(_long(MASK32)))


def char_sum(text) -> Column:
    """Sum of signed bytes modulo 2**32."""
    return F.aggregate(_bytes(_c(text)), _long(0), lambda h, b: h + b).bitwiseAND(_long(MASK32))


def long_to_base64(number) -> Column:
    """Positional numeral in base 64, highest digit first, 0 is "A", no padding; numbers are not negative."""
    n = _c(number).cast("long")
    parts = [F.substring(F.lit(BASE64), F.shiftrightunsigned(n, 6 * i).bitwiseAND(_long(63)).cast("int") + 1, F.lit(1)) for i in range(10, -1, -1)]
    text = F.concat(*parts)
    return F.when(n == 0, "A").otherwise(F.regexp_replace(text, "^A+", ""))


def base64_to_long(text) -> Column:
    """Number of a base-64 numeral; an unknown letter counts as 0."""
    letters = F.split(_c(text), "")
    return F.aggregate(letters, _long(0), lambda n, c: n * 64 + _digit(BASE64, c))


def _digit(letters: str, c: Column) -> Column:
    """Place of a letter from 0; 0 if it is unknown or empty."""
    at = F.call_function("locate", c, F.lit(letters))
    return F.when((F.length(c) == 0) | (at == 0), _long(0)).otherwise(at.cast("long") - 1)


def base64_rfc(text) -> Column:
    """Base 64 of the UTF-8 bytes, in one line."""
    return F.regexp_replace(F.base64(F.encode(_c(text), "UTF-8")), "[\r\n]", "")


def kmer_to_base64(kmer) -> Column:
    """Four letters to a byte (A 0, T 1, C 2, G 3, zeros at the end), then base64."""
    kmer = _c(kmer)
    digits = F.translate(kmer, PACK_ORDER, "0123")
    padded = F.rpad(digits, (F.ceil(F.length(kmer) / 4) * 4).cast("int"), "0")
    packed = F.transform(F.sequence(F.lit(1), F.length(padded) - 3, F.lit(4)), lambda i: F.lpad(F.conv(F.substring(padded, i, 4), 4, 16), 2, "0"))
    return F.when(F.length(kmer) == 0, "").when(kmer.isNotNull(), F.regexp_replace(F.base64(F.unhex(F.concat_ws("", packed))), "[\r\n]", ""))


def split_evenly(text, n: int) -> Column:
    """n parts of length div n as (offset, part), the rest with the last; a text shorter than n is an error."""
    text = _c(text)
    size = F.floor(F.length(text) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * size).alias("offset"), F.substring(text, i * size + 1, F.when(i < n - 1, size).otherwise(F.length(text))).alias("part")))
    return F.when(text.isNull(), None).otherwise(_must(F.length(text) >= n, "text is shorter than its number of parts", parts, False))


def split_any(text, delimiters: str, keep_empty: bool = False) -> Column:
    """Parts between any of the delimiter characters. Empty parts go; with ``keep_empty`` only one at the end does."""
    escaped = "".join("\\" + d if d in "\\]^-[" else d for d in delimiters)
    parts = F.split(_c(text), f"[{escaped}]", -1)
    if not keep_empty:
        return F.filter(parts, lambda x: x != "")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def trim_space(text, left: bool = True, right: bool = True) -> Column:
    """Without white space of any kind at its ends."""
    edges = [p for p, on in ((r"^\s+", left), (r"\s+$", right)) if on]
    return F.regexp_replace(_c(text), "|".join(edges), "") if edges else _c(text)


def register(spark) -> None:
    """SQL functions of the same semantics, as SQL UDFs, so that they stay in the JVM."""
    define = {
        "normalize_sequence(s STRING)": ("STRING", "regexp_replace(translate(s, 'acgt', 'ACGT'), '[^ACGT]', 'N')"),
        "reverse_complement(s STRING)": ("STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
        "canonical_kmer(s STRING)": ("STRING", "least(s, reverse(translate(s, 'ACGT', 'TGCA')))"),
        "kmer_to_number(s STRING)": ("BIGINT", f"cast(conv(translate(s, '{CODE_ORDER}', '0123'), 4, 10) AS BIGINT)"),
        "number_to_kmer(n BIGINT, k INT)": ("STRING", f"translate(lpad(conv(cast(n AS STRING), 10, 4), k, '0'), '0123', '{CODE_ORDER}')"),
        "kmers(s STRING, k INT)": (
            "ARRAY<STRING>",
            "flatten(transform(filter(split(s, 'N'), x -> length(x) >= k), x -> transform(sequence(1, length(x) - k + 1), i -> substring(x, i, k))))",
        ),
    }
    for head, (kind, body) in define.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
