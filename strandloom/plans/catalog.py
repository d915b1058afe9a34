"""Queries by name, each with the SQL that gives the same rows, where SQL can.

The tables have no sequences, so reads are made from texts: the hexadecimal digits of two MD5 sums as letters, with f as
N (short reads, whose pairs of reads and of words SQL can still list), or for the queries named ``long_`` all letters of
whole texts. Planes and vectors are made from small integers, so that sums are exact in any order and engine.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import streaming
from strandloom.functions import seq as S
from strandloom.functions import vec as V
from strandloom.operators import blocks as B
from strandloom.operators import context as C
from strandloom.operators import edges as E
from strandloom.operators import embed, lsh, train
from strandloom.operators import kmers as N
from strandloom.sources import files
from strandloom.sources import reads as R
from strandloom.storage import checkpoint_dir, local

K, BITS, HALF_WINDOW, DIM, NEG = 6, 4, 3, 4, 2
HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digits = F.concat(F.md5(F.concat(text, F.lit("0"))), F.md5(F.concat(text, F.lit("1"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(digits, HEX, DNA).alias("seq"))


#: Letters of whole texts as bases, in turn; a line end is a gap, all else is left out.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\n"
BASES = ("ACGT" * 13)[:52] + "N"


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as long as the texts, letter by letter."""
    return N.lettered(table(spark, sf_dir, "documents"), ["doc_id"], "text", LETTERS, BASES)


def planes(k: int = K, bits: int = BITS) -> lsh.Planes:
    p, s = np.arange(k)[:, None], np.arange(bits)[None, :]
    return lsh.Planes(((p * 7 + s * 13 + 3) % 11 - 5) + 1j * ((p * 5 + s * 11 + p * s) % 13 - 6), np.arange(bits) * 3 % 5 - 2)


def kmers(spark, sf_dir, k=K, canonical=True) -> DataFrame:
    return reads(spark, sf_dir).select("doc_id", F.posexplode(S.kmers_forward("seq", k, canonical)).alias("pos", "kmer"))


def words(spark, sf_dir) -> DataFrame:
    return lsh.hash_reads(reads(spark, sf_dir), planes(), ["doc_id"])


def model(spark, column: str = "wi", shift: int = 0):
    word = F.col("word")
    return [(((word * 31 + d * 17 + shift) % 101) / 100.0) for d in range(DIM)]


def vectors(spark) -> DataFrame:
    return spark.range(1 << BITS).withColumnRenamed("id", "word").select("word", F.array(*model(spark)).alias("wi"), F.array(*model(spark, shift=50)).alias("wo"))


# SQL pieces, most of them common table expressions.
def _key(*parts) -> str:
    """``context.order_key`` in SQL."""
    return f"('0x' || substr(md5({" || ':' || ".join(f'({p})' for p in parts)}), 1, 15))::BIGINT"


_READS = f"reads AS (SELECT doc_id, translate(md5(coalesce(text, '') || '0') || md5(coalesce(text, '') || '1'), '{HEX}', '{DNA}') AS seq FROM documents)"


def _km(k: int = K) -> str:
    return f"""seg AS (SELECT doc_id, unnest(string_split(seq, 'N')) AS s, generate_subscripts(string_split(seq, 'N'), 1) AS g FROM reads),
raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, p) - 1 AS pos, substr(s, p, {k}) AS forward FROM (SELECT doc_id, g, s, unnest(range(1, length(s) - {k} + 2)) AS p FROM seg WHERE length(s) >= {k})),
km AS (SELECT doc_id, pos, forward, least(forward, reverse(translate(forward, 'ACGT', 'TGCA'))) AS kmer FROM raw)"""


_PLANES = f"""planes AS (SELECT p, s, base, CASE base WHEN 'A' THEN -a WHEN 'T' THEN a WHEN 'C' THEN b ELSE -b END AS w
FROM (SELECT p, s, (p * 7 + s * 13 + 3) % 11 - 5 AS a, (p * 5 + s * 11 + p * s) % 13 - 6 AS b FROM range({K}) t(p), range({BITS}) u(s)), (VALUES ('A'), ('C'), ('G'), ('T')) v(base))"""


def _hash(column: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, pos, sum(CASE WHEN w > s * 3 % 5 - 2 THEN 1 << s ELSE 0 END)::BIGINT AS word FROM (SELECT doc_id, pos, planes.s, sum(w) AS w
FROM (SELECT doc_id, pos, {column} AS x, unnest(range({K})) AS p FROM km) JOIN planes ON planes.p = x_p.p AND base = substr(x, x_p.p + 1, 1) GROUP BY 1, 2, 3) GROUP BY 1, 2)""".replace("FROM km) JOIN", "FROM km) x_p JOIN")


_WORDS = ",\n".join([_READS, _km(), _PLANES, _hash("kmer", "words")])


def _frame(lo: str, hi: str) -> str:
    return f"coalesce(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {lo} AND {hi}), [])"


_CONTEXT = _WORDS + f",\ncx AS (SELECT doc_id, pos, word AS center, list_concat({_frame(f'{HALF_WINDOW} PRECEDING', '1 PRECEDING')}, {_frame('1 FOLLOWING', f'{HALF_WINDOW - 1} FOLLOWING')}) AS context FROM words)"
_VECTORS = f"vectors AS (SELECT word, d, ((word * 31 + d * 17) % 101) / 100.0::DOUBLE AS wi, ((word * 31 + d * 17 + 50) % 101) / 100.0::DOUBLE AS wo FROM range({1 << BITS}) t(word), range({DIM}) u(d))"
_STEP = _CONTEXT + f""",
{_VECTORS},
ex AS (SELECT doc_id, pos, center, context FROM cx WHERE len(context) > 0),
inp AS (SELECT doc_id, pos, unnest(context) AS word FROM ex),
hid AS (SELECT doc_id, pos, d, avg(wi) AS h FROM inp JOIN vectors USING (word) GROUP BY 1, 2, 3),
neg AS (SELECT doc_id, pos, center, ((((doc_id * 1000 + pos) * 1103515245 + 12345 * (i + 1)) % 2147483648) % {(1 << BITS) - 1}) AS r FROM ex, range({NEG}) t(i)),
tgt AS (SELECT doc_id, pos, center AS word, 1.0::DOUBLE AS y FROM ex UNION ALL SELECT doc_id, pos, r + CASE WHEN r >= center THEN 1 ELSE 0 END, 0.0::DOUBLE FROM neg),
tid AS (SELECT *, row_number() OVER () AS t FROM tgt),
sc AS (SELECT t, doc_id, pos, word, y, 1 / (1 + exp(-sum(wo * h))) AS score FROM tid JOIN vectors USING (word) JOIN hid USING (doc_id, pos, d) GROUP BY 1, 2, 3, 4, 5),
al AS (SELECT *, 0.1::DOUBLE * (y - score) AS alpha FROM sc)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {_READS}, {_km()} SELECT kmer, count(*) AS n FROM km GROUP BY 1")
def canonical_kmer_count(spark, sf):
    return kmers(spark, sf).groupBy("kmer").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(s) AS normal_md5, length(s)::BIGINT AS length, length(replace(s, 'N', ''))::BIGINT AS known FROM (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS s FROM documents)")
def normalize_sequence(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", S.normalize_sequence("text").alias("s"))
    return s.select("doc_id", F.md5("s").alias("normal_md5"), F.length("s").cast("long").alias("length"), F.length(F.replace("s", F.lit("N"), F.lit(""))).cast("long").alias("known"))


@query(f"WITH {_READS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(spark, sf):
    return reads(spark, sf).select("doc_id", S.reverse_complement("seq", checked=True).alias("rc"))


@query(f"WITH {_READS} SELECT doc_id, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS canonical FROM reads")
def canonical_form(spark, sf):
    return reads(spark, sf).select("doc_id", S.canonical_kmer("seq").alias("canonical"))


@query(f"WITH {_READS}, {_km()} SELECT doc_id, pos, forward AS kmer FROM km")
def kmer_explode_forward(spark, sf):
    return kmers(spark, sf, canonical=False).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {_READS}, {_km(5)}, strands AS (SELECT doc_id, forward AS x FROM km UNION SELECT doc_id, reverse(translate(forward, 'ACGT', 'TGCA')) FROM km)
SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS kmers FROM strands GROUP BY 1"""
)
def kmer_distinct_both_strands(spark, sf):
    found = reads(spark, sf).select("doc_id", S.kmers_both_strands("seq", 5, canonical=False).alias("k")).where(F.size("k") > 0)
    return found.select("doc_id", F.size("k").cast("long").alias("n"), F.concat_ws(",", F.array_sort("k")).alias("kmers"))


@query(f"WITH {_READS}, {_km()} SELECT doc_id, count(DISTINCT kmer) AS n FROM km GROUP BY 1")
def distinct_kmers(spark, sf):
    return kmers(spark, sf).groupBy("doc_id").agg(F.count_distinct("kmer").alias("n"))


@query(f"WITH {_READS}, {_km()} SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 20")
def top_kmers(spark, sf):
    return canonical_kmer_count(spark, sf).orderBy(F.desc("n"), "kmer").limit(20)


_NUMBER = f"list_sum(list_transform(range({K}), lambda i: (strpos('CTAG', substr(forward, i + 1, 1)) - 1) * (1 << (2 * ({K} - 1 - i)))))::BIGINT"


@query(f"WITH {_READS}, {_km()} SELECT doc_id, pos, {_NUMBER} AS number FROM km")
def kmer_number_encode(spark, sf):
    return kmers(spark, sf, canonical=False).select("doc_id", F.col("pos").cast("long").alias("pos"), S.kmer_to_number("kmer").alias("number"))


@query(f"WITH {_READS}, {_km()} SELECT DISTINCT forward AS kmer, {_NUMBER} AS number FROM km")
def kmer_number_decode(spark, sf):
    numbers = kmers(spark, sf, canonical=False).select(S.kmer_to_number("kmer").alias("number")).distinct()
    return numbers.select(S.number_to_kmer("number", K).alias("kmer"), "number")


@query(f"WITH {_READS}, {_km()}, n AS (SELECT DISTINCT doc_id, {_NUMBER.replace('forward', 'kmer')} AS number FROM km) SELECT doc_id, count(*) AS n, sum(number)::BIGINT AS total FROM n GROUP BY 1")
def kmer_numbers(spark, sf):
    return reads(spark, sf).select("doc_id", F.explode(S.kmer_numbers("seq", K)).alias("x")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


_PACK = "(strpos('ATCG', substr(x, i, 1)) - 1)"


@query(
    f"""WITH {_READS}, s AS (SELECT doc_id, replace(seq, 'N', '') AS seq FROM reads), p AS (SELECT doc_id, rpad(seq, ((length(seq) + 3) // 4 * 4)::INT, 'A') AS x FROM s)
SELECT doc_id, base64(unhex(array_to_string(list_transform(range(1, length(x) + 1, 2), lambda i: substr('{HEX}', {_PACK} * 4 + {_PACK.replace('i, 1', 'i + 1, 1')} + 1, 1)), ''))) AS packed FROM p"""
)
def kmer_base64(spark, sf):
    return reads(spark, sf).select("doc_id", S.kmer_to_base64(F.replace("seq", F.lit("N"), F.lit(""))).alias("packed"))


@query(
    f"""WITH n AS (SELECT doc_id, doc_id * 7919 * 104729 AS n FROM documents)
SELECT doc_id, n AS number, CASE WHEN n = 0 THEN 'A' ELSE ltrim(array_to_string(list_transform(range(10, -1, -1), lambda i: substr('{S.BASE64}', ((n >> (6 * i)) & 63)::INT + 1, 1)), ''), 'A') END AS numeral FROM n"""
)
def long_base64(spark, sf):
    n = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 * 104729).alias("n"))
    text = n.select("doc_id", S.long_to_base64("n").alias("numeral"))
    return text.select("doc_id", S.base64_to_long("numeral").alias("number"), "numeral")


@query("SELECT doc_id, md5(base64(encode(coalesce(text, '')))) AS b64_md5 FROM documents")
def rfc_base64(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.base64_rfc(F.coalesce("text", F.lit("")))).alias("b64_md5"))


@query(
    f"WITH {_READS} SELECT doc_id, list_reduce(list_prepend({S.FNV_OFFSET}::BIGINT, list_transform(string_split(seq, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: (xor(h, b) * {S.FNV_PRIME}) & {S.MASK32}) AS hash FROM reads"
)
def fnv1a_hash(spark, sf):
    return reads(spark, sf).select("doc_id", S.fnv1a("seq").alias("hash"))


@query(f"WITH {_READS} SELECT doc_id, list_sum(list_transform(string_split(seq, ''), lambda x: ascii(x)))::BIGINT AS hash FROM reads")
def char_sum_hash(spark, sf):
    return reads(spark, sf).select("doc_id", S.char_sum("seq").alias("hash"))


@query(f"WITH {_READS} SELECT doc_id, i * 12 AS \"offset\", substr(seq, i * 12 + 1, CASE WHEN i < 4 THEN 12 ELSE 64 END) AS part FROM reads, range(5) t(i)")
def split_evenly(spark, sf):
    parts = reads(spark, sf).select("doc_id", F.explode(S.split_evenly("seq", 5)).alias("p"))
    return parts.select("doc_id", F.col("p.offset").cast("long").alias("offset"), "p.part")


@query("SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS parts_md5 FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ ,.]'), lambda x: x <> '') AS p FROM documents)")
def split_drop_empty(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", S.split_any(F.coalesce("text", F.lit("")), " ,.").alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.concat_ws("|", "p")).alias("parts_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(chr(9) || ' ' || text || ' ' || chr(10), '^\s+', ''), '\s+$', '')) AS trimmed_md5 FROM documents")
def trim_space(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.trim_space(F.concat(F.lit("\t "), "text", F.lit(" \n")))).alias("trimmed_md5"))


_HASHED = f"WITH {_WORDS} SELECT doc_id, pos, word FROM words"


@query(_HASHED)
def lsh_hash_column(spark, sf):
    return kmers(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), lsh.lsh_hash("kmer", planes()).alias("word"))


@query(_HASHED)
def lsh_hash_joined(spark, sf):
    return lsh.hash_joined(kmers(spark, sf), planes(), ["doc_id", "pos"]).withColumn("pos", F.col("pos").cast("long"))


@query(_HASHED)
def lsh_hash_arrow(spark, sf):
    return words(spark, sf).select("doc_id", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_READS}, {_km()}, {_PLANES}, {_hash('forward', 'f')}, {_hash(chr(114) + 'everse(translate(forward, ' + repr('ACGT') + ', ' + repr('TGCA') + '))', 'r')} SELECT doc_id, pos, least(f.word, r.word) AS word FROM f JOIN r USING (doc_id, pos)")
def lsh_hash_rc_min(spark, sf):
    return kmers(spark, sf, canonical=False).select("doc_id", F.col("pos").cast("long").alias("pos"), lsh.lsh_hash("kmer", planes(), both=True).alias("word"))


@query(f"WITH {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1")
def lsh_bucket_histogram(spark, sf):
    return words(spark, sf).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_READS}, {_km()}, n AS (SELECT count(*) AS n, count(DISTINCT kmer) AS m FROM km)
SELECT p AS pos, base, s AS spoke, (CASE base WHEN 'A' THEN -a WHEN 'T' THEN a WHEN 'C' THEN b ELSE -b END)::DOUBLE AS w
FROM (SELECT p, s, (p * 7 + s * 13 + n) % 11 - 5 AS a, (p * 5 + s * 11 + m) % 13 - 6 AS b FROM n, range({K}) t(p), range({BITS}) u(s)), (VALUES ('A'), ('C'), ('G'), ('T')) v(base)"""
)
def lsh_encode(spark, sf):
    """Real weights of planes that follow the table's numbers of k-mers, after the file form and back."""
    n, m = kmers(spark, sf).agg(F.count("*"), F.count_distinct("kmer")).first()
    p, s = np.arange(K)[:, None], np.arange(BITS)[None, :]
    made = lsh.Planes(((p * 7 + s * 13 + n) % 11 - 5) + 1j * ((p * 5 + s * 11 + m) % 13 - 6), np.zeros(BITS))
    rows = lsh.Planes.from_bytes(made.to_bytes()).rows()
    return spark.createDataFrame(rows, "pos int, base string, spoke int, w double").select(F.col("pos").cast("long").alias("pos"), "base", F.col("spoke").cast("long").alias("spoke"), (F.col("w") + 0.0).alias("w"))


_SAMPLED = f"""{_READS}, tries AS (SELECT doc_id, seq, {_key(3, 0, 'doc_id', 0)} AS key, {_key(3, 0, 'doc_id', 0, "'start'")} % (length(seq) - {K}) AS start FROM reads WHERE length(seq) > {K}),
picked AS (SELECT key, doc_id, substr(seq, start + 1, {K}) AS x FROM tries),
sample AS (SELECT key, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, row_number() OVER (ORDER BY key, doc_id) - 1 AS i FROM picked WHERE NOT contains(x, 'N') ORDER BY key, doc_id LIMIT {2 * K * BITS})"""


@query(f"WITH {_SAMPLED} SELECT key, kmer FROM sample")
def sampled_kmers(spark, sf):
    """Draws by key: the smallest keys of one try for each read."""
    return lsh.sampled(reads(spark, sf), K, 2 * K * BITS, seed=3, keys=["doc_id"]).select("key", "kmer")


@query(
    f"""WITH {_SAMPLED}, dealt AS (SELECT s AS plane, kmer, i, row_number() OVER (PARTITION BY s ORDER BY md5('3:' || s || ':' || i)) AS r FROM sample, range({BITS}) t(s))
SELECT plane, i AS number, kmer, TRUE AS on_plane FROM dealt WHERE r <= {K}"""
)
def fitted_planes(spark, sf):
    """Planes fitted to sampled k-mers: each goes through its own, to 1e-9."""
    kmers_ = lsh.sample_kmers(reads(spark, sf), K, BITS, seed=3, keys=["doc_id"])
    off = lsh.residuals(lsh.fit_planes(kmers_, BITS, seed=3), kmers_)
    rows = [(s, i, kmers_[i], bool(off[i, s] < 1e-9)) for s in range(BITS) for i in lsh.chosen(len(kmers_), K, s, 3)]
    return spark.createDataFrame(rows, "plane long, number long, kmer string, on_plane boolean")


@query(f"WITH {_CONTEXT} SELECT doc_id, pos, center, array_to_string(context, ',') AS context FROM cx")
def cbow_context(spark, sf):
    own = C.contexts(words(spark, sf), HALF_WINDOW, ["doc_id"])
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), "center", F.concat_ws(",", F.transform("context", lambda x: x.cast("string"))).alias("context"))


@query(f"WITH {_CONTEXT} SELECT doc_id, pos, center, array_to_string(context, ',') AS context FROM cx")
def cbow_context_windowed(spark, sf):
    rows = words(spark, sf).select("doc_id", F.posexplode("words").alias("pos", "word"))
    own = C.contexts_windowed(rows, HALF_WINDOW, ["doc_id"])
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), "center", F.concat_ws(",", F.transform("context", lambda x: x.cast("string"))).alias("context"))


@query(f"WITH {_WORDS} SELECT a.doc_id, a.pos, a.word AS center, b.word AS context FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos >= a.pos - {HALF_WINDOW} AND b.pos < a.pos + {HALF_WINDOW} AND a.pos <> b.pos")
def skipgram_pairs(spark, sf):
    return C.skipgram_pairs(words(spark, sf), HALF_WINDOW, ["doc_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_CONTEXT} SELECT center AS word, count(*) AS n FROM cx WHERE len(context) > 0 GROUP BY 1")
def word_count_cbow(spark, sf):
    return C.word_counts(words(spark, sf), HALF_WINDOW, ["doc_id"])


@query(f"WITH {_CONTEXT} SELECT center AS word, sum(len(context))::BIGINT AS n FROM cx WHERE len(context) > 0 GROUP BY 1")
def word_count_skipgram(spark, sf):
    return C.word_counts(words(spark, sf), HALF_WINDOW, ["doc_id"], skipgram=True)


@query(f"WITH {_CONTEXT}, c AS (SELECT center AS word, count(*) AS n FROM cx WHERE len(context) > 0 GROUP BY 1) SELECT word, coalesce(n, 0) AS n FROM range(64) t(word) LEFT JOIN c USING (word)")
def word_count_dense(spark, sf):
    return C.dense_counts(word_count_cbow(spark, sf), 6)


@query(f"WITH {_CONTEXT} SELECT center AS word, count(*) AS n FROM cx WHERE len(context) > 0 GROUP BY 1 ORDER BY n DESC, word LIMIT 5")
def top_words(spark, sf):
    return C.top_words(word_count_cbow(spark, sf), 5)


@query(
    f"""SELECT doc_id, i, r + CASE WHEN r >= doc_id % 16 THEN 1 ELSE 0 END AS word
FROM (SELECT doc_id, i, ((doc_id * 1103515245 + 12345 * (i + 1)) % 2147483648) % 15 AS r FROM documents, range({NEG}) t(i))"""
)
def negative_samples(spark, sf):
    picks = C.negatives_lcg(F.col("doc_id") % 16, 16, NEG, "doc_id")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(picks).alias("i", "word")).withColumn("i", F.col("i").cast("long"))


@query()
def negative_samples_hashed(spark, sf):
    picks = C.negatives(F.col("doc_id") % 16, 16, 5, F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.explode(picks).alias("word"))


@query(f"SELECT doc_id, i, r + CASE WHEN r >= doc_id % 16 THEN 1 ELSE 0 END AS word FROM (SELECT doc_id, i, {_key(0, 0, 'doc_id', 'i')} % 15 AS r FROM documents, range(5) t(i))")
def negative_samples_keyed(spark, sf):
    picks = C.negatives_keyed(F.col("doc_id") % 16, 16, 5, "doc_id")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(picks).alias("i", "word")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {_WORDS}, l AS (SELECT doc_id, list(word ORDER BY pos) AS w FROM words GROUP BY 1) SELECT doc_id, i AS chunk, array_to_string(w[i * 7 + 1:i * 7 + 7], ',') AS words FROM (SELECT doc_id, w, unnest(range((len(w) + 6) // 7)) AS i FROM l)")
def word_chunks(spark, sf):
    parts = words(spark, sf).select("doc_id", F.posexplode(C.chunks("words", 7)).alias("chunk", "w"))
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.concat_ws(",", F.transform("w", lambda x: x.cast("string"))).alias("words"))


_COUNTED = f"""{_READS}, {_km()}, c AS (SELECT {_NUMBER.replace('forward', 'kmer')} AS word, count(*) AS n FROM km GROUP BY 1),
counted AS (SELECT t.word, coalesce(n, 0) AS n FROM range(4096) t(word) LEFT JOIN c USING (word)),
parts AS (SELECT word, n, d, ((word * 31 + d * 17 + n) % 101) / 100.0::DOUBLE AS wi FROM counted, range({DIM}) u(d))"""


def counted_vectors(spark, sf) -> DataFrame:
    """word, n, wi: for each possible 6-mer how often it occurs, and a vector made from that."""
    counts = kmers(spark, sf).select(S.kmer_to_number("kmer").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return C.dense_counts(counts, 12).select("word", "n", F.array(*(((F.col("word") * 31 + d * 17 + F.col("n")) % 101) / 100.0 for d in range(DIM))).alias("wi"))


@query(f"WITH {_COUNTED} SELECT word, n, least(word // 819, 4)::INT AS rank FROM counted")
def word_ranges(spark, sf):
    return C.by_range(counted_vectors(spark, sf), 5).select("word", "n", C.word_rank("word", 4096, 5).alias("rank"))


@query(
    f"""WITH {_READS}, {_km(12)}, h AS (SELECT DISTINCT doc_id, kmer FROM km)
SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM h a JOIN h b ON a.kmer = b.kmer AND a.doc_id < b.doc_id"""
)
def shared_kmer_edges(spark, sf):
    held = kmers(spark, sf, 12).select(F.col("doc_id").alias("read"), "kmer")
    return E.every_shared_kmer_edge(held)


_CLASSES = f"""{_READS}, {_km(12)}, sets AS (SELECT doc_id, string_agg(DISTINCT kmer, ',' ORDER BY kmer) AS k FROM km GROUP BY 1),
members AS (SELECT doc_id AS read, min(doc_id) OVER (PARTITION BY k) AS class, count(*) OVER (PARTITION BY k) AS n FROM sets)"""


@query(f"WITH {_CLASSES} SELECT * FROM members")
def shared_kmer_members(spark, sf):
    """All edges in small: which reads hold the same 12-mers."""
    held = kmers(spark, sf, 12).select(F.col("doc_id").alias("read"), "kmer")
    return E.kmer_classes(held)[0].select("read", F.col("id").alias("class"), "n")


@query(f"WITH {_CLASSES}, h AS (SELECT DISTINCT class, kmer FROM km JOIN members ON read = doc_id) SELECT DISTINCT a.class AS src, b.class AS dst FROM h a JOIN h b ON a.kmer = b.kmer AND a.class < b.class")
def shared_kmer_class_links(spark, sf):
    """And which of these classes share a 12-mer."""
    held = kmers(spark, sf, 12).select(F.col("doc_id").alias("read"), "kmer")
    return E.kmer_classes(held)[1].select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"))


@query(
    f"""WITH {_READS}, {_km(8)}, h AS (SELECT DISTINCT doc_id, kmer FROM km),
c AS (SELECT kmer, doc_id, count(*) OVER (PARTITION BY kmer) AS n, row_number() OVER (PARTITION BY kmer ORDER BY {_key(0, 0, 'doc_id')} % {E.SHARES}, doc_id) - 1 AS i FROM h),
t AS (SELECT kmer, n, unnest(range((n * 5)::BIGINT)) AS t FROM (SELECT DISTINCT kmer, n FROM c WHERE n > 10)),
d AS (SELECT kmer, {_key(0, 0, 'kmer', 't', 0)} % n AS u, {_key(0, 0, 'kmer', 't', 1)} % n AS v FROM t),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM c a JOIN c b USING (kmer) WHERE a.n <= 10 AND a.doc_id < b.doc_id
UNION ALL SELECT a.doc_id, b.doc_id FROM d JOIN c a ON a.kmer = d.kmer AND a.i = d.u JOIN c b ON b.kmer = d.kmer AND b.i = d.v WHERE u <> v)
SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM e"""
)
def shared_kmer_edges_capped(spark, sf):
    """All pairs of up to ten reads of a k-mer; of more, five times as many draws as there are reads."""
    held = kmers(spark, sf, 8).select(F.col("doc_id").alias("read"), "kmer")
    return E.shared_kmer_edges(held, 10)


@query(
    f"""WITH {_WORDS}, o AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM words), u AS (SELECT doc_id, pos, word FROM o WHERE p IS NULL OR p <> word)
SELECT a.doc_id, a.word AS src, b.word AS dst FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.pos < b.pos"""
)
def generate_edges_all(spark, sf):
    """All edges of whole reads, which have 59 words at most."""
    return words(spark, sf).select("doc_id", F.explode(E.generate_edges("words", 64)).alias("e")).select("doc_id", "e.src", "e.dst")


@query(
    f"""WITH {_WORDS}, l AS (SELECT doc_id, list(word ORDER BY pos) AS w, count(*) AS n FROM words GROUP BY 1),
o AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM words), u AS (SELECT doc_id, pos, word FROM o WHERE p IS NULL OR p <> word),
d AS (SELECT doc_id, w, n, unnest(range(1, n * 15 + 1)) AS t FROM l WHERE n > 30),
x AS (SELECT doc_id, w[{_key(0, 0, 't', 0, 'doc_id')} % n + 1] AS src, w[{_key(0, 0, 't', 1, 'doc_id')} % n + 1] AS dst FROM d)
SELECT a.doc_id, a.word AS src, b.word AS dst FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.pos < b.pos JOIN l ON l.doc_id = a.doc_id WHERE l.n <= 30
UNION ALL SELECT doc_id, src, dst FROM x WHERE src <> dst"""
)
def generate_edges_capped(spark, sf):
    return E.read_edges(words(spark, sf), 30, ["doc_id"])


@query(f"WITH {_WORDS}, {_VECTORS} SELECT doc_id, pos, word, round(sum(wi), 6) AS total FROM words JOIN vectors USING (word) GROUP BY 1, 2, 3")
def embedding_lookup(spark, sf):
    rows = words(spark, sf).select("doc_id", F.posexplode("words").alias("pos", "word"))
    held = embed.lookup(rows, vectors(spark).withColumn("wi", F.col("wi").cast("array<float>")))
    return held.select("doc_id", F.col("pos").cast("long").alias("pos"), "word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


_POOLED = f"WITH {_WORDS}, {_VECTORS}, m AS (SELECT doc_id, d, avg(wi) AS x FROM words JOIN vectors USING (word) GROUP BY 1, 2) SELECT reads.doc_id, d, round(coalesce(x, 0), 9) AS x FROM reads CROSS JOIN range({DIM}) t(d) LEFT JOIN m USING (doc_id, d)"


def _exploded(df):
    return df.select("doc_id", F.posexplode("vec").alias("d", "x")).select("doc_id", F.col("d").cast("long").alias("d"), F.round("x", 9).alias("x"))


@query(_POOLED)
def mean_pool_reads(spark, sf):
    return _exploded(embed.mean_pool_joined(words(spark, sf), vectors(spark), ["doc_id"], DIM))


@query(_POOLED)
def mean_pool_reads_broadcast(spark, sf):
    return _exploded(embed.mean_pool_broadcast(words(spark, sf), vectors(spark), ["doc_id"], DIM))


@query("SELECT label, d, round(avg(x), 5) AS x FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def mean_pool_label(spark, sf):
    means = V.mean_by(table(spark, sf, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("vec").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 5).alias("x"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS dot FROM embeddings")
def vector_dot(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.dot("embedding", "embedding"), 5).alias("dot"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE + 0.5 * x::DOUBLE)), 5) AS axpy, round(list_sum(list_transform(embedding, lambda x: 3 * x::DOUBLE)), 5) AS mul, round(2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS added FROM embeddings")
def vector_math(spark, sf):
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5)
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", total(V.axpy(0.5, e, e)).alias("axpy"), total(V.mul(e, 3.0)).alias("mul"), total(V.add(e, e)).alias("added"))


@query(f"WITH {_COUNTED} SELECT word, string_agg(printf('%.6f', wi), ' ' ORDER BY d) AS line FROM parts GROUP BY 1")
def embed_text_format(spark, sf):
    return counted_vectors(spark, sf).select("word", V.to_text("wi").alias("line"))


@query("SELECT doc_id, round(CASE WHEN x < -8 THEN 0.0 WHEN x > 8 THEN 1.0 ELSE 1 / (1 + exp(-(floor((x + 8) * 32) / 32 - 8))) END, 9) AS y FROM (SELECT doc_id, ((doc_id % 640) / 32.0 - 10)::DOUBLE AS x FROM documents)")
def sigmoid_table(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(V.sigmoid_table((F.col("doc_id") % 640) / 32.0 - 10), 9).alias("y"))


@query("SELECT doc_id, round(CASE WHEN x > 1 THEN 0.0 ELSE ln((floor(x * 512) + 1e-5) / 512) END, 9) AS y FROM (SELECT doc_id, ((doc_id % 300) / 256.0)::DOUBLE AS x FROM documents)")
def log_table(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(V.log_table((F.col("doc_id") % 300) / 256.0), 9).alias("y"))


def _rows(spark, sf):
    rows = train.examples(words(spark, sf), HALF_WINDOW, ["doc_id"])
    picks = C.negatives_lcg("center", 1 << BITS, NEG, F.col("doc_id") * 1000 + F.col("pos"))
    return rows.withColumn("negatives", picks)


@query(f"WITH {_STEP} SELECT doc_id, pos, round(sum(-CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END) / {NEG}, 6) AS loss FROM al GROUP BY 1, 2")
def cbow_step_loss(spark, sf):
    losses = train.sql_step(_rows(spark, sf), vectors(spark), 0.1, NEG, ["doc_id", "pos"], exact_sigmoid=True, width=2 * HALF_WINDOW - 1)[1]
    return losses.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("loss", 6).alias("loss"))


def _moved(context: str) -> str:
    return f"""{context},
dout AS (SELECT word, d, sum(alpha * h) AS x FROM al JOIN hid USING (doc_id, pos) GROUP BY 1, 2),
grad AS (SELECT doc_id, pos, d, sum(alpha * wo) AS g FROM al JOIN vectors USING (word) GROUP BY 1, 2, 3),
din AS (SELECT word, d, sum(g) AS x FROM inp JOIN grad USING (doc_id, pos) GROUP BY 1, 2)
SELECT v.word, v.d, round(v.wi + coalesce(din.x, 0), 5) AS wi, round(v.wo + coalesce(dout.x, 0), 5) AS wo FROM vectors v LEFT JOIN din ON din.word = v.word AND din.d = v.d LEFT JOIN dout ON dout.word = v.word AND dout.d = v.d"""


def _components(model) -> DataFrame:
    both = model.select("word", F.posexplode(F.arrays_zip("wi", "wo")).alias("d", "x"))
    return both.select("word", F.col("d").cast("long").alias("d"), F.round("x.wi", 5).alias("wi"), F.round("x.wo", 5).alias("wo"))


#: Negatives as ``_rows`` draws them.
_DRAW = B.congruent_draw(1 << BITS, NEG, lambda read, pos: read * 1000 + pos)


def _block_step(spark, rows, column="words", made=None):
    """One step on a parameter table: (model, losses)."""
    params = B.Params.create(vectors(spark), DIM)
    new, losses = params.step_of_reads(rows, B.Step(0.1, NEG, HALF_WINDOW, _DRAW, exact_sigmoid=True), "doc_id", column, made)
    params.drop()
    return new.table(), losses


@query(f"WITH {_moved(_STEP)}")
def sgns_one_step_update(spark, sf):
    return _components(_block_step(spark, words(spark, sf))[0])


@query(f"WITH {_moved(_STEP)}")
def sgns_step_by_joins(spark, sf):
    """The same step by joins and sums alone."""
    return _components(train.sql_step(_rows(spark, sf), vectors(spark), 0.1, NEG, ["doc_id", "pos"], exact_sigmoid=True, width=2 * HALF_WINDOW - 1)[0])


@query(
    f"""WITH {_STEP}, l AS (SELECT doc_id, sum(-CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END) / {NEG} AS loss FROM al GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1)
SELECT count(*) AS reads, round(sum(coalesce(loss / n, 0)) / count(*), 5) AS loss FROM reads LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def block_epoch_loss(spark, sf):
    """The mean over reads, those without words included, of the mean over a read's words."""
    return B.mean_loss(_block_step(spark, words(spark, sf))[1]).select("reads", F.round("loss", 5).alias("loss"))


@query(f"WITH {_READS} SELECT count(*) AS n, sum(length(seq))::BIGINT AS letters FROM reads")
def record_count(spark, sf):
    return reads(spark, sf).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"))


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(spark, sf, line, suffix) -> str:
    path = _folder(spark) + suffix
    reads(spark, sf).where("seq <> ''").select(line.alias("value")).write.text(path)
    return path


_SEQS = f"WITH {_READS} SELECT seq FROM reads"


@query(f"WITH {_READS} SELECT '>' || doc_id AS id, seq FROM reads")
def scan_fasta(spark, sf):
    path = _written(spark, sf, F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.expr("substring(seq, 1, 30)"), F.lit("\n"), F.expr("substring(seq, 31)")), ".fa")
    return R.scan_fasta(spark, path).select("id", "seq")


@query(f"WITH {_READS} SELECT '@' || doc_id AS id, seq FROM reads")
def scan_fastq(spark, sf):
    path = _written(spark, sf, F.concat(F.lit("@"), "doc_id", F.lit("\n"), "seq", F.lit("\n+\nIIII")), ".fq")
    return R.scan_fastq(spark, path).select("id", "seq")


@query(_SEQS)
def scan_seqtext(spark, sf):
    return R.scan_text(spark, _written(spark, sf, F.col("seq"), ".txt")).select("seq")


def _trained(spark, sf, **more):
    return train.train(words(spark, sf), train.Options(BITS, dim=8, lr=0.1, half_window=HALF_WINDOW, neg=NEG, epochs=2, seed=1, **more))


@query()
def train_local_sgd(spark, sf):
    return _trained(spark, sf)[0]


@query()
def train_minibatch(spark, sf):
    """The same with 64 contexts at once."""
    return _trained(spark, sf, batch=64)[0]


@query()
def transform_end_to_end(spark, sf):
    found = embed.mean_pool(words(spark, sf), _trained(spark, sf, batch=64)[0], ["doc_id"], 8)
    return found.orderBy("doc_id").select("doc_id", V.to_text("vec").alias("line"))


@query(
    f"""WITH {_WORDS}, m AS (SELECT doc_id, d, sum((word * 31 + d * 17) % 101) / count(*)::DOUBLE AS x FROM words, range({DIM}) u(d) GROUP BY 1, 2)
SELECT reads.doc_id, string_agg(printf('%.6f', coalesce(x, 0)::DOUBLE), ' ' ORDER BY d) AS line FROM reads CROSS JOIN range({DIM}) t(d) LEFT JOIN m USING (doc_id, d) GROUP BY 1"""
)
def transform_lines(spark, sf):
    """Reads to words to lines of mean vectors, with vectors of whole numbers, so that any engine prints the same; by the file and back."""
    word = F.col("word")
    model_ = spark.range(1 << BITS).withColumnRenamed("id", "word").select("word", F.array(*(((word * 31 + d * 17) % 101).cast("double") for d in range(DIM))).alias("wi"))
    found = embed.mean_pool(words(spark, sf), model_, ["doc_id"], DIM)
    path = _folder(spark)
    files.save_embeddings(found.withColumn("vec", F.concat(F.array(F.col("doc_id").cast("double")), "vec")), path, ["doc_id"])
    line = F.split("value", " ", 2)
    return spark.read.text(path).select(F.get(line, F.lit(0)).cast("double").cast("long").alias("doc_id"), F.get(line, F.lit(1)).alias("line"))


@query(f"WITH {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1")
def streaming_word_count(spark, sf):
    """Running counts of a stream of files, after the last of them."""
    path = _written(spark, sf, F.col("seq"), "-stream")
    stream = spark.readStream.schema("value string").text(path).select(F.col("value").alias("seq"))
    name = f"counts_{uuid.uuid4().hex}"
    q = streaming.word_counts(stream, planes()).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query(f"WITH {_WORDS}, {_VECTORS}, m AS (SELECT doc_id, d, avg(wi) AS x FROM words JOIN vectors USING (word) GROUP BY 1, 2) SELECT seq, d, round(coalesce(x, 0), 9) AS x FROM reads CROSS JOIN range({DIM}) t(d) LEFT JOIN m USING (doc_id, d)")
def streaming_transform(spark, sf):
    path = _written(spark, sf, F.col("seq"), "-stream")
    stream = spark.readStream.schema("value string").text(path).select(F.col("value").alias("seq"))
    out = _folder(spark)
    done = streaming.transform(stream, planes(), vectors(spark), ["seq"], DIM)
    q = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("seq", F.posexplode("vec").alias("d", "x")).select("seq", F.col("d").cast("long").alias("d"), F.round("x", 9).alias("x"))


def _waves(spark, sf):
    """Two folders of FASTA files, of even and odd ids."""
    for part in range(2):
        path = _folder(spark)
        rows = reads(spark, sf).where(F.pmod("doc_id", F.lit(2)) == part)
        rows.select(F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.expr("substring(seq, 1, 30)"), F.lit("\n"), F.expr("substring(seq, 31)")).alias("value")).repartition(4).write.text(path)
        yield path


@query(f"WITH {_READS} SELECT '>' || doc_id AS id, seq FROM reads")
def streaming_fasta_source(spark, sf):
    """The Python source on a folder whose second half of files comes later, with older times; a restart goes on where the first run ended."""
    R.register(spark)
    folder, out, log = (_folder(spark) for _ in range(3))
    os.makedirs(local(folder))
    for turn, path in enumerate(_waves(spark, sf)):
        for f in sorted(glob.glob(f"{local(path)}/part-*")):
            new = f"{local(folder)}/{'ab'[1 - turn]}-{os.path.basename(f)}.fa"
            shutil.copy(f, new)
            os.utime(new, (1e9 - turn * 1e6,) * 2)
        stream = spark.readStream.format("fasta").load(local(folder)).select("id", "seq")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, seq string").parquet(out)


@query(f"WITH {_READS} SELECT '>' || doc_id AS id, seq FROM reads")
def streaming_fasta_files(spark, sf):
    """Spark's file stream of two folders, one after the other, by one checkpoint each; a batch writes under its number."""
    out = _folder(spark)
    for turn, path in enumerate(_waves(spark, sf)):
        sink = lambda rows, number, turn=turn: rows.select("id", "seq").write.mode("overwrite").parquet(f"{out}/turn={turn}/batch={number}")
        R.stream_fasta(spark, path, sink).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, seq string").parquet(out).select("id", "seq")


# Reads as long as texts. Planes hash each distinct k-mer once.
_LONG = f"""reads AS (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '[^a-zA-Z\n]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)"""
_LONG_WORDS = ",\n".join([_LONG, _km(), _PLANES])
_LONG_WORDS += f""",
once AS (SELECT DISTINCT kmer FROM km),
named AS (SELECT kmer, sum(CASE WHEN w > s * 3 % 5 - 2 THEN 1 << s ELSE 0 END)::BIGINT AS word FROM (SELECT kmer, planes.s, sum(w) AS w FROM (SELECT kmer, unnest(range({K})) AS p FROM once) x_p JOIN planes ON planes.p = x_p.p AND base = substr(kmer, x_p.p + 1, 1) GROUP BY 1, 2) GROUP BY 1),
words AS (SELECT doc_id, pos, word FROM km JOIN named USING (kmer))"""


def long_words(spark, sf) -> DataFrame:
    return lsh.hash_reads(long_reads(spark, sf), planes(), ["doc_id"])


@query(f"WITH {_LONG}, {_km()} SELECT kmer, count(*) AS n FROM km GROUP BY 1")
def long_canonical_kmer_count(spark, sf):
    return N.counts(long_reads(spark, sf), K)


@query(f"WITH {_LONG}, {_km()} SELECT doc_id, count(DISTINCT kmer) AS n FROM km GROUP BY 1")
def long_distinct_kmers(spark, sf):
    return N.distinct_counts(long_reads(spark, sf), K, ["doc_id"])


@query(f"WITH {_LONG_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1")
def long_lsh_bucket_histogram(spark, sf):
    return long_words(spark, sf).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {_LONG_WORDS}, c AS (SELECT word, count(*) OVER (PARTITION BY doc_id) AS n FROM words) SELECT word, count(*) AS n FROM c WHERE n > 1 GROUP BY 1")
def long_word_count_cbow(spark, sf):
    return C.word_counts(long_words(spark, sf), HALF_WINDOW, ["doc_id"])


@query(
    f"""WITH {_LONG_WORDS}, c AS (SELECT doc_id, pos, word, count(*) OVER (PARTITION BY doc_id) AS n FROM words)
SELECT word, sum(least(pos, {HALF_WINDOW}) + least(n - 1 - pos, {HALF_WINDOW - 1}))::BIGINT AS n FROM c WHERE n > 1 GROUP BY 1"""
)
def long_word_count_skipgram(spark, sf):
    return C.word_counts(long_words(spark, sf), HALF_WINDOW, ["doc_id"], skipgram=True)


@query(f"WITH {_LONG_WORDS}, {_VECTORS}, t AS (SELECT doc_id, word, count(*) AS c FROM words GROUP BY 1, 2), m AS (SELECT doc_id, d, sum(wi * c) / sum(c) AS x FROM t JOIN vectors USING (word) GROUP BY 1, 2) SELECT reads.doc_id, d, round(coalesce(x, 0), 9) AS x FROM reads CROSS JOIN range({DIM}) t(d) LEFT JOIN m USING (doc_id, d)")
def long_mean_pool(spark, sf):
    return _exploded(embed.mean_pool(long_words(spark, sf), vectors(spark), ["doc_id"], DIM))


_LONG_STEP = _LONG_WORDS + _STEP.removeprefix(_WORDS)


@query(f"WITH {_moved(_LONG_STEP)}")
def long_sgns_step(spark, sf):
    """A step of training on reads as long as texts, which are cut into pieces; a task makes reads and words of texts itself."""
    letters, hashed = N.letter_batches(LETTERS, BASES), lsh.hash_batches(spark.sparkContext.broadcast(planes()))
    return _components(_block_step(spark, table(spark, sf, "documents"), "text", lambda batches: hashed(letters(batches)))[0])


@query(f"WITH {_LONG_WORDS}, {_CONTEXT.removeprefix(_WORDS).removeprefix(',')} SELECT doc_id, count(*) AS n, sum(center * (pos % 97 + 1) * len(context))::BIGINT AS centers, coalesce(sum(list_sum(list_transform(context, lambda x, i: x * i))), 0)::BIGINT AS around FROM cx GROUP BY 1")
def long_cbow_context(spark, sf):
    """Windows of whole texts, as sums that tell places apart."""
    own = C.contexts(long_words(spark, sf), HALF_WINDOW, ["doc_id"])
    around = reduce(lambda a, b: a + b, (F.coalesce(F.get("context", F.lit(i)), F.lit(0)) * (i + 1) for i in range(2 * HALF_WINDOW - 1)))
    return own.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("center") * (F.col("pos") % 97 + 1) * F.size("context")).alias("centers"), F.sum(around).alias("around"))


@query(f"WITH {_LONG_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1")
def long_streaming_word_count(spark, sf):
    """Running counts of a stream of reads as long as texts."""
    path = _folder(spark) + "-stream"
    long_reads(spark, sf).where("seq <> ''").select(F.col("seq").alias("value")).write.text(path)
    stream = spark.readStream.schema("value string").text(path).select(F.col("value").alias("seq"))
    name = f"counts_{uuid.uuid4().hex}"
    q = streaming.word_counts(stream, planes()).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# Files: what is written is read back by the sources and sinks.
@query(f"WITH {_LONG} SELECT '>' || doc_id AS id, seq FROM reads WHERE seq <> ''")
def long_scan_fasta(spark, sf):
    path = _folder(spark) + ".fa"
    lines = F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    long_reads(spark, sf).where("seq <> ''").select(lines.alias("value")).write.text(path)
    return R.scan_fasta(spark, path).select("id", "seq")


def _loaded(spark, sf, suffix, compression="none", **options):
    """Records by the Python sources, from two folders of files."""
    mark, tail = (">", "") if suffix == ".fa" else ("@", "\n+\nIIII")
    paths = []
    for part in range(2):
        paths.append(_folder(spark) + suffix)
        rows = reads(spark, sf).where(F.pmod("doc_id", F.lit(2)) == part)
        rows.select(F.concat(F.lit(mark), "doc_id", F.lit("\n"), "seq", F.lit(tail)).alias("value")).write.text(paths[-1], compression=compression)
    return R.load(spark, paths, "fasta" if suffix == ".fa" else "fastq")


@query(f"WITH {_READS} SELECT '>' || doc_id AS id, seq FROM reads")
def load_fasta(spark, sf):
    return _loaded(spark, sf, ".fa").select("id", "seq")


@query(f"WITH {_READS} SELECT '@' || doc_id AS id, seq FROM reads")
def load_fastq_gzip(spark, sf):
    return _loaded(spark, sf, ".fq", "gzip").select("id", "seq")


@query(f"WITH {_READS} SELECT '>' || doc_id AS id, seq FROM reads")
def scan_fasta_gzip(spark, sf):
    path = _folder(spark) + ".fa"
    reads(spark, sf).select(F.concat(F.lit(">"), "doc_id", F.lit("\n"), "seq").alias("value")).write.text(path, compression="gzip")
    return R.scan_fasta(spark, path).select("id", "seq")


@query(f"WITH {_READS} SELECT seq FROM reads WHERE doc_id % 100 <= 40")
def scan_text_stops_at_blank(spark, sf):
    """A hundred files with the reads in order, and a blank line after some of them that ends the file."""
    path = _folder(spark) + ".txt"
    rows = reads(spark, sf).withColumn("_file", (F.col("doc_id") / 100).cast("long"))
    line = F.concat("seq", F.when(F.pmod("doc_id", F.lit(100)) == 40, F.lit("\n")).otherwise(F.lit("")))
    rows.repartition("_file").sortWithinPartitions("_file", "doc_id").select("_file", line.alias("value")).write.partitionBy("_file").text(path)
    return R.scan_text(spark, path).select("seq")


@query(f"WITH {_COUNTED} SELECT word, string_agg(printf('%.6f', wi::FLOAT), ' ' ORDER BY d) AS line FROM parts GROUP BY 1")
def vector_file(spark, sf):
    """Vectors after the binary file and back."""
    path = _folder(spark) + ".vec.bin"
    files.save_vectors(counted_vectors(spark, sf), path)
    return files.load_vectors(spark, path).select("word", V.to_text("wi").alias("line"))


@query(f"WITH {_COUNTED} SELECT string_agg(printf('%.6f', wi), ' ' ORDER BY d) AS line FROM parts GROUP BY word")
def vector_text_file(spark, sf):
    path = _folder(spark)
    files.save_text_vectors(counted_vectors(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {_CONTEXT} SELECT center AS word, count(*) AS n FROM cx WHERE len(context) > 0 GROUP BY 1")
def word_count_file(spark, sf):
    path = _folder(spark)
    files.save_counts(word_count_cbow(spark, sf), path)
    return files.load_counts(spark, path)


# Training pieces.
@query(f"WITH {_STEP}, l AS (SELECT doc_id, pos, sum(-CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END) / {NEG} AS loss FROM al GROUP BY 1, 2) SELECT doc_id, round(avg(loss), 6) AS loss FROM l GROUP BY 1")
def read_loss(spark, sf):
    losses = train.sql_step(_rows(spark, sf), vectors(spark), 0.1, NEG, ["doc_id", "pos"], exact_sigmoid=True, width=2 * HALF_WINDOW - 1)[1]
    return losses.groupBy("doc_id").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(f"WITH {_STEP}, l AS (SELECT doc_id, pos, sum(-CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END) / {NEG} AS loss FROM al GROUP BY 1, 2), r AS (SELECT doc_id, avg(loss) AS loss FROM l GROUP BY 1) SELECT count(*) AS reads, round(avg(loss), 5) AS loss FROM r")
def epoch_loss(spark, sf):
    losses = train.sql_step(_rows(spark, sf), vectors(spark), 0.1, NEG, ["doc_id", "pos"], exact_sigmoid=True, width=2 * HALF_WINDOW - 1)[1]
    return losses.groupBy("doc_id").agg((V.exact_sum("loss") / F.count("*")).alias("loss")).agg(F.count("*").alias("reads"), F.round(V.exact_sum("loss") / F.count("*"), 5).alias("loss"))


@query(f"WITH {_READS}, {_km()}, n AS (SELECT DISTINCT {_NUMBER.replace('forward', 'kmer')} AS word FROM km) SELECT word, d, 0.2::DOUBLE AS x FROM n, range(5) u(d)")
def uniform_vectors(spark, sf):
    seen = kmers(spark, sf).select(S.kmer_to_number("kmer").alias("word")).distinct()
    made = train.initial(seen, train.Options(12, dim=5, init="uniform"))
    return made.select("word", F.posexplode("wi").alias("d", "x")).select("word", F.col("d").cast("long").alias("d"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("SELECT doc_id, round(0.3 * (7 - doc_id % 7) / 7, 9) AS rate FROM documents")
def learning_rates(spark, sf):
    """The rate of the epoch that each document's id falls on."""
    return table(spark, sf, "documents").select("doc_id", F.round(train.Options(4, epochs=7).rate(F.col("doc_id") % 7), 9).alias("rate"))


@query(_HASHED)
def shuffled_words(spark, sf):
    """A shuffled batch holds the same rows."""
    rows = words(spark, sf).select("doc_id", F.posexplode("words").alias("pos", "word"))
    return C.shuffled(rows, 3).select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@query(f"SELECT doc_id, batch, row_number() OVER (PARTITION BY batch ORDER BY o, doc_id) - 1 AS place FROM (SELECT doc_id, doc_id // 100 AS batch, {_key(7, 2, 'doc_id')} AS o FROM documents)")
def shuffled_reads(spark, sf):
    """The order in which reads are trained in an epoch: batches of a hundred, each shuffled by key."""
    return C.shuffled_batches(reads(spark, sf), "doc_id", 100, seed=7, epoch=2).select("doc_id", "batch", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, split_part('r' || doc_id || '-' || coalesce(lang, '') || '-x', '-', 2) AS label FROM documents")
def labels_of_ids(spark, sf):
    ids = F.concat(F.lit("r"), "doc_id", F.lit("-"), F.coalesce("lang", F.lit("")), F.lit("-x"))
    return table(spark, sf, "documents").select("doc_id", R.labels_from_id(ids, 1).alias("label"))


@query("SELECT doc_id, ends_with(coalesce(text, ''), '.') AS stops FROM documents")
def ends_with(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.endswith(F.coalesce("text", F.lit("")), F.lit(".")).alias("stops"))
