import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom import cli, streaming
from strandloom.operators import lsh
from strandloom.plans.catalog import planes
from strandloom.sources import files, reads, records

A, B = "ACGTN" * 70 + "A", "GGCC" * 75


@pytest.fixture
def data(tmp_path):
    wrap = lambda s: "\n".join(s[i : i + 60].lower() for i in range(0, len(s), 60))
    texts = {
        "s.fa": f">one first\n{wrap(A)}\n>two\n{wrap(B)}\n\n",
        "s.fq": f"@one first\n{A}\n+\nIIII\n\n@two\n{B}\n+\nII\n\n",
        "s.txt": f"{A}\n{B}\n\n{A}\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
    return tmp_path


@pytest.mark.parametrize("name, ids", [("s.fa", [">one first", ">two"]), ("s.fq", ["@one first", "@two"]), ("s.txt", [">useless"] * 2)])
@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_load(spark, data, name, ids, suffix):
    rows = reads.load(spark, str(data / (name + suffix))).orderBy("rec_idx").collect()
    assert [r.id for r in rows] == ids and [r.seq for r in rows] == [A, B]


def test_several_files_keep_their_order(spark, data):
    rows = reads.load(spark, [str(data / "s.fq"), str(data / "s.fa.gz")]).orderBy("file_idx", "rec_idx").collect()
    assert [len(r.seq) for r in rows] == [351, 300, 351, 300]
    (data / "dir").mkdir()
    (data / "dir" / "b.fa").write_text(">b\nAC\n")
    (data / "dir" / "a.fa").write_text(">a\nAC\n")
    assert [r.id for r in reads.load(spark, str(data / "dir")).orderBy("file_idx").collect()] == [">a", ">b"]
    with pytest.raises(FileNotFoundError):
        reads.load(spark, str(data / "none.fa"))


def test_scan(spark, data):
    place = ["file", "block", "row"]
    for f, name in ((reads.scan_fasta, "s.fa"), (reads.scan_fasta, "s.fa.gz"), (reads.scan_fastq, "s.fq"), (reads.scan_text, "s.txt")):
        rows = f(spark, str(data / name)).orderBy(*place).collect()
        assert [r.seq for r in rows] == [A, B], name
    assert [r.id for r in reads.scan_fasta(spark, str(data / "s.fa")).orderBy(*place).collect()] == [">one first", ">two"]
    assert reads.scan_text(spark, str(data / "s.txt"), stop_at_blank=False).count() == 3
    assert [r.x for r in reads.scan_fasta(spark, str(data / "s.fa")).select(reads.labels_from_id(F.lit("a-b-c"), 1).alias("x")).collect()] == ["b", "b"]


def test_scan_splits_large_files(spark, tmp_path):
    (tmp_path / "big.fa").write_text("".join(f">r{i}\n{'ACGT' * 20}\n{'GG' * 10}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = reads.scan_fasta(spark, str(tmp_path / "big.fa")).orderBy("file", "block", "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.id for r in rows] == [f">r{i}" for i in range(3000)] and {len(r.seq) for r in rows} == {100}
    assert len({r.block for r in rows}) > 3


def test_malformed_files(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nAC\n")
    (tmp_path / "bad.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    for name in ("bad.fa", "bad.fq"):
        with pytest.raises(Exception, match="before the first header|are left"):
            reads.load(spark, str(tmp_path / name)).collect()
        assert reads.load(spark, str(tmp_path / name), mode="PERMISSIVE").count() == 1
    with pytest.raises(Exception, match="before the first header"):
        reads.scan_fasta(spark, str(tmp_path / "bad.fa")).collect()
    with pytest.raises(records.Malformed):
        list(records.fastq(["a", "AC", "+", "II"]))
    assert list(records.fastq(["a", "AC", "+", "II"], lenient=True)) == [("a", "AC")]
    assert list(records.fasta(["  >a ", " AC", "", "GT "])) == [(">a", "ACGT")]


def test_vector_and_count_files(spark, tmp_path):
    model = spark.createDataFrame([(i, [float(i), 0.5], [0.0, 0.0], i) for i in range(5)], "word long, wi array<float>, wo array<float>, wc long")
    for path in (str(tmp_path / "v.bin"), str(tmp_path / "v.bin.gz")):
        assert files.save_vectors(model, path) == 5
        assert {r.word: r.wi for r in files.load_vectors(spark, path).collect()} == {i: [float(i), 0.5] for i in range(5)}
    with pytest.raises(ValueError):
        files.save_vectors(model.where("word > 0"), str(tmp_path / "x.bin"))
    files.save_counts(model.select("word", F.col("wc").alias("n")), str(tmp_path / "wc"))
    assert [(r.word, r.n) for r in files.load_counts(spark, str(tmp_path / "wc")).orderBy("word").collect()] == [(i, i) for i in range(5)]
    files.save_model(model, str(tmp_path / "m"), dim=2)
    back, params = files.load_model(spark, str(tmp_path / "m"))
    assert params == {"dim": 2} and sorted(back.collect()) == sorted(model.collect())
    with pytest.raises(FileExistsError):
        files.new_folder(str(tmp_path / "m"))


def test_vector_files_in_parts(spark, tmp_path, monkeypatch):
    """Records are written and read by many tasks, in place; words that a model lacks come from elsewhere."""
    monkeypatch.setattr(files, "PART_BYTES", 300)
    model = spark.createDataFrame([(i, [float(i), -1.0, 0.25]) for i in range(0, 500, 3)], "word long, wi array<float>")
    rest = spark.range(500).select(F.col("id").alias("word"), F.array(F.lit(7.0), F.lit(8.0), F.lit(9.0)).cast("array<float>").alias("wi"))
    path = str(tmp_path / "v.bin")
    assert files.save_vectors(model, path, size=500, missing=rest) == 500
    back = files.load_vectors(spark, path)
    assert back.rdd.getNumPartitions() > 20
    assert {r.word: r.wi for r in back.collect()} == {i: [7.0, 8.0, 9.0] if i % 3 else [float(i), -1.0, 0.25] for i in range(500)}
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        files.load_vectors(spark, path)
    files.save_text_vectors(model.where("word < 7"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == [f"{i}.000000 -1.000000 0.250000" for i in (0, 3, 6)]


def test_fastq_records_across_splits(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'I' * (i % 5)}{'I'}\n" for i in range(400))
    (tmp_path / "s.fq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = reads.scan_fastq(spark, str(tmp_path / "s.fq")).orderBy("block", "row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block for r in rows}) > 5 and [(r.id, r.seq) for r in rows] == [(f"@r{i}", "ACGT" * (i % 9 + 1)) for i in range(400)]


def test_command_line(spark, data, capsys):
    rnd = random.Random(1)
    x, y = ("".join(rnd.choice("ACGT") for _ in range(n)) for n in (351, 300))
    (data / "s.fa").write_text(f">one\n{x}\n>two\n{y}\n")
    (data / "s.fq").write_text(f"@one\n{x}\n+\nI\n@two\n{y}\n+\nI\n")
    rp, model, out = (str(data / n) for n in ("rp.bin", "model", "out"))
    cli.main(["rphash", "-i", str(data / "s.fa"), "-k", "5", "--hash-size", "4", "-o", rp])
    cli.main(["train", "--fastq", "--hash-file", rp, "--dim", "6", "--epoch", "1", "--half-window", "2", "-o", model, str(data / "s.fq")])
    cli.main(["transform", "--fasta", "--hash-file", rp, "--vec", model, "-o", out, str(data / "s.fa")])
    lines = [r.value for r in spark.read.text(out).collect()]
    assert len(lines) == 2 and all(len(x.split()) == 6 for x in lines)
    # The vector file holds all 16 words, those that occur with their trained vectors.
    trained = {r.word: r.wi for r in files.load_model(spark, model)[0].collect()}
    whole = {r.word: r.wi for r in files.load_vectors(spark, f"{model}/model.vec.bin").collect()}
    assert len(whole) == 16 and all(whole[w] == v for w, v in trained.items())
    cli.main(["transform", "--fasta", "--hash-file", rp, "--vec", f"{model}/model.vec.bin", "-o", out + "2", str(data / "s.fa")])
    assert [r.value for r in spark.read.text(out + "2").collect()] == lines
    (data / "in").mkdir()
    (data / "in" / "s.fa").write_text(f">one\n{x}\n")
    parts = ["train-parts", "--fasta", "--hash-file", rp, "--dim", "4", "--epoch", "1", "--half-window", "2", "--ranks", "3", "-o", str(data / "parts")]
    cli.main([*parts, str(data / "in")])
    found, counted = {}, {}
    for r in range(3):
        raw = (data / "parts" / f"part_r{r:06d}").read_bytes()
        words = [tuple(map(int, line.split())) for line in (data / "parts" / f"part_r{r:06d}.wc.txt").read_text().splitlines()]
        assert len(raw) == 8 + len(words) * 24 and all(min(w // 5, 2) == r for w, _ in words)
        found[r] = [v.wi for v in files.load_vectors(spark, str(data / "parts" / f"part_r{r:06d}")).collect()]
        counted |= dict(words)
    assert sum(map(len, found.values())) == len(counted) and sum(counted.values()) == 347
    with pytest.raises(FileExistsError):
        cli.main([*parts, str(data / "in")])
    with pytest.raises(SystemExit):
        cli.main([*parts[:-1], str(data / "other"), str(data / "s.fa")])
    with pytest.raises(SystemExit):
        cli.main(["train", "--fasta", "--fastq", "--hash-file", rp, "x"])
    with pytest.raises(ValueError):
        lsh.Planes.load(str(data / "s.fa"))


def test_streams(spark, data, tmp_path):
    reads.register(spark)
    (data / "in").mkdir()
    (data / "in" / "a.fa").write_text(f">a\n{A}\n")
    stream = spark.readStream.format("fasta").load(str(data / "in"))
    counts = streaming.word_counts(stream, planes())
    q = counts.writeStream.outputMode("complete").format("memory").queryName("n").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    first = spark.table("n").agg(F.sum("n")).first()[0]
    (data / "in" / "b.fa").write_text(f">b\n{B}\n")
    q.processAllAvailable()
    q.stop()
    assert not first and spark.table("n").agg(F.sum("n")).first()[0] == len(B) - planes().k + 1
