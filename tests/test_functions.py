import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.functions import vec as V


def one(spark, *cols, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("kmer, number", [("ATCG", 147), ("ATCGATC", 9444), ("ATCGACGTAACCACTGGTAC", 633736300504)])
def test_kmer_numbers(spark, kmer, number):
    assert tuple(one(spark, S.kmer_to_number("x"), S.number_to_kmer(F.lit(number), len(kmer)), x=kmer)) == (number, kmer)


def test_long_kmers_and_bad_letters(spark):
    rnd = random.Random(1)
    for k in (1, 16, 31):
        x = "".join(rnd.choice("ACGT") for _ in range(k))
        n = 0
        for c in x:
            n = n * 4 + "CTAG".index(c)
        assert one(spark, S.kmer_to_number("x"), S.number_to_kmer(S.kmer_to_number("x"), k), x=x) == (n, x)
    for bad in ("A" * 32, "ACN", ""):
        assert one(spark, S.kmer_to_number("x", lenient=True), x=bad)[0] is None
        with pytest.raises(Exception, match="k-mers have"):
            one(spark, S.kmer_to_number("x"), x=bad)
    with pytest.raises(Exception, match="ACGTN"):
        one(spark, S.reverse_complement("x", checked=True), x="ACX")


def test_canonical(spark):
    x = "GCAAAGAAAACGCTGGAAAACAGCGTGCTGG"
    want = "CCAGCACGCTGTTTTCCAGCGTTTTCTTTGC"
    assert tuple(one(spark, S.canonical_kmer("x"), S.canonical_kmer(S.reverse_complement("x")), S.reverse_complement(S.reverse_complement("x")), x=x)) == (want, want, x)


@pytest.mark.parametrize("seq, k, canonical, n", [("ATCG", 4, True, 1), ("ATCG", 5, True, 0), ("ATCGATC", 3, False, 4), ("ATCGATC", 3, True, 2), ("ATCGACGTNACNACTGGTAC", 5, True, 8)])
def test_kmers_of_both_strands(spark, seq, k, canonical, n):
    assert len(one(spark, S.kmers_both_strands("x", k, canonical), x=seq)[0]) == n


@pytest.mark.parametrize("seq, k, n", [("ATCG", 4, 1), ("ATCG", 5, 0), ("ATCGATC", 3, 5), ("ATCGACGTNACNACTGGTAC", 5, 8), ("", 3, 0), ("NNN", 1, 0)])
def test_forward_kmers_are_in_order(spark, seq, k, n):
    plain, canonical = one(spark, S.kmers_forward("x", k, False), S.kmers_forward("x", k), x=seq)
    want = [p[i : i + k] for p in seq.split("N") for i in range(len(p) - k + 1)]
    assert plain == want and len(want) == n and canonical == [min(x, rc(x)) for x in want]


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "x string")
    cols = [S.normalize_sequence("x"), S.reverse_complement("x"), S.canonical_kmer("x"), S.kmers_forward("x", 3), S.kmer_to_number("x"), S.trim_space("x"), S.kmer_to_base64("x"), S.split_evenly("x", 2)]
    assert set(df.select(*cols).first()) == {None}


def test_normalize(spark):
    assert one(spark, S.normalize_sequence("x"), x="acgTnRu-\r ")[0] == "ACGTNNNNNN"


def test_codecs(spark):
    for n in (0, 12358, 3223212358, 83223212358):
        text, back = one(spark, S.long_to_base64("x"), S.base64_to_long(S.long_to_base64("x")), x=n)
        assert back == n and (n or text == "A")
    assert one(spark, S.base64_to_long("x"), x="B?")[0] == 64
    assert tuple(one(spark, S.kmer_to_base64("x"), S.kmer_to_base64(F.lit("GGGGCCT")), x="ATCGA")) == ("GwA=", "/6Q=")
    assert one(spark, S.base64_rfc("x"), x="a" * 100)[0] == "YWFh" * 33 + "YQ=="


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ (b | 0xFFFFFF00 if b > 127 else b)) * 16777619) & 0xFFFFFFFF
        return h

    for x in ("", "a", "ACGT", "é漢"):
        assert one(spark, S.fnv1a("x"), x=x)[0] == fnv(x)
    assert one(spark, S.fnv1a("x"), x=1234)[0] == fnv("1234")
    assert one(spark, S.char_sum("x"), x="abc")[0] == 294


def test_splits_and_trims(spark):
    assert len(one(spark, S.split_any("x", " "), x="  a b   c       d  e  ")[0]) == 5
    assert len(one(spark, S.split_any("x", ","), x="123,12 313,asdsaf,,")[0]) == 3
    assert one(spark, S.split_any("x", ","), x="")[0] == []
    assert one(spark, S.split_any("x", ",", keep_empty=True), x="a,,b,")[0] == ["a", "", "b"]
    assert one(spark, S.trim_space("x"), x=" \t\nAAA\r\n ")[0] == "AAA"
    assert [tuple(p) for p in one(spark, S.split_evenly("x", 3), x="abcdefgh")[0]] == [(0, "ab"), (2, "cd"), (4, "efgh")]
    with pytest.raises(Exception, match="shorter"):
        one(spark, S.split_evenly("x", 3), x="ab")


def test_random_kmers(spark):
    df = spark.range(200).select(S.random_kmer(F.lit("ACGTTGCAAC"), 4, F.rand(1), F.rand(2) < 0.5).alias("k"), S.random_kmer(F.lit("ACGT"), 4, F.rand(1)).alias("none"))
    own = {"ACGTTGCAAC"[i : i + 4] for i in range(6)}
    assert all((r.k in own or rc(r.k) in own) and r.none is None for r in df.collect())


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))
    got = one(spark, V.add(a, b), V.axpy(2.0, a, b), V.mul(a, 3.0), V.dot(a, b), V.zeros(2), V.uniform(4), V.to_text(a), x=1)
    assert tuple(got) == ([4.0, 1.0], [5.0, 3.0], [3.0, 6.0], 1.0, [0.0, 0.0], [0.25] * 4, "1.000000 2.000000")
    r = spark.range(50).select(V.randomized(3, 1).alias("v")).collect()
    assert all(-1 <= x < 1 for row in r for x in row.v)


def test_tables(spark):
    from strandloom.operators import train

    for x in (-9.0, -8.0, -3.3, 0.0, 0.01, 7.99, 8.0, 8.1):
        assert one(spark, V.sigmoid_table("x"), x=x)[0] == pytest.approx(train.sigmoid(x))
    for x in (0.0, 0.3, 0.999, 1.0, 1.5):
        assert one(spark, V.log_table("x"), x=x)[0] == pytest.approx(train.log(x), abs=1e-9)


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT canonical_kmer('TTT'), kmer_to_number('ATCG'), number_to_kmer(147, 4), kmers('ACGNACG', 3), normalize_sequence('acx'), reverse_complement('AAC')").first()
    assert tuple(row) == ("AAA", 147, "ATCG", ["ACG", "ACG"], "ACN", "GTT")
