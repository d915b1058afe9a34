"""Streams of files, and folders of many files."""

import os

import pytest
from pyspark.sql import functions as F

from strandloom.sources import reads


def put(path, text, age):
    path.write_text(text)
    os.utime(path, (1.7e9 - age,) * 2)


def started(spark, folder, out, log):
    stream = spark.readStream.format("fasta").load(str(folder)).select("file", "file_idx", "rec_idx", "id", "seq")
    return stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log))


def seen(spark, out):
    return sorted((r.id, r.file_idx) for r in spark.read.schema("file string, file_idx int, rec_idx long, id string, seq string").parquet(str(out)).collect())


def test_late_files_with_older_times_are_read_once(spark, tmp_path):
    """A file moved in late keeps its old time; ties of time don't matter; hidden names are left out."""
    reads.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.fa", ">a\nACGT\n", 100)
    put(folder / "b.fa", ">b\nACGT\n", 50)
    put(folder / "_SUCCESS", "", 0)
    q = started(spark, folder, tmp_path / "out", tmp_path / "log").start()
    q.processAllAvailable()
    assert seen(spark, tmp_path / "out") == [(">a", 0), (">b", 1)]
    put(folder / "c.fa", ">c\nACGT\n", 200)
    q.processAllAvailable()
    put(folder / "a0.fa", ">a0\nACGT\n>a1\nGG\n", 50)
    q.processAllAvailable()
    q.stop()
    assert seen(spark, tmp_path / "out") == [(">a", 0), (">a0", 3), (">a1", 3), (">b", 1), (">c", 2)]


def test_a_restart_goes_on_from_the_log(spark, tmp_path):
    reads.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    names = []
    for turn in range(3):
        for i in range(3):
            names.append(f"{'zma'[turn]}{i}")
            put(folder / f"{names[-1]}.fa", f">{names[-1]}\nAC\n", turn * 100 + i)
        started(spark, folder, tmp_path / "out", tmp_path / "log").trigger(availableNow=True).start().awaitTermination()
        assert [n for n, _ in seen(spark, tmp_path / "out")] == sorted(f">{n}" for n in names)
    started(spark, folder, tmp_path / "out", tmp_path / "log").trigger(availableNow=True).start().awaitTermination()
    assert len(seen(spark, tmp_path / "out")) == 9


def test_offsets_are_logs(tmp_path):
    """What the engine does: offsets are kept as JSON, and a new reader knows only those."""
    options = {"path": str(tmp_path)}
    for name in ("b", "c"):
        put(tmp_path / f"{name}.fa", ">x\nA\n", 10)
    one = reads._StreamReader(options, "fasta")
    start, first = one.initialOffset(), one.latestOffset()
    put(tmp_path / "a.fa", ">x\nA\n", 500)
    (tmp_path / "b.fa").unlink()
    other = reads._StreamReader(options, "fasta")
    numbers = lambda parts: [(os.path.basename(f), n) for p in parts for f, n in p.files]
    # A batch that was planned before the restart; of its files only those that are still there can be read.
    assert numbers(other.partitions(start, first)) == [("c.fa", 0)]
    last = other.latestOffset()
    assert numbers(other.partitions(first, last)) == [("a.fa", 2)] and last["count"] == 3
    put(tmp_path / "b.fa", ">x\nA\n", 1)
    assert other.latestOffset() == last


@pytest.mark.parametrize("checked", [True, False])
def test_file_stream_gives_what_a_scan_gives(spark, tmp_path, checked):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        put(folder / f"{i}.fa", f">{i} one\nac\ngt\n>>{i} two\n\n  GG \n>{i} three\n" + (">last\n" + "ACGTN" * 500 if i == 2 else ""), i)
    got = []
    q = reads.stream_fasta(spark, str(folder), lambda rows, number: got.extend((number, r.id, r.seq) for r in rows.collect()), checked).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True)
    q.start().awaitTermination()
    assert sorted(g[1:] for g in got) == sorted((r.id, r.seq) for r in reads.scan_fasta(spark, str(folder), checked).collect())
    put(folder / "older.fa", ">older\nAC", 10_000)
    q.start().awaitTermination()
    assert got[-1] == (1, ">older", "AC") and len(got) == 14


def test_ten_thousand_small_files_in_tens_of_tasks(spark, tmp_path):
    """In order, by near-equal bytes; a large file among them stays one."""
    for i in range(10_000):
        (tmp_path / f"f{i:05d}.fa").write_text(f">{i}\nACGT\n")
    (tmp_path / "f05000.fa").write_text(">5000\n" + "ACGT" * 100)
    df = reads.load(spark, str(tmp_path), "fasta")
    assert 10 <= df.rdd.getNumPartitions() <= 99
    rows = df.select("file_idx", "rec_idx", "id").collect()
    assert [(r.file_idx, r.rec_idx, r.id) for r in rows] == [(i, 0, f">{i}") for i in range(10_000)]
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * min(sizes)


def test_packing_by_bytes(monkeypatch, tmp_path):
    monkeypatch.setattr(reads, "PART_BYTES", 100)
    monkeypatch.setattr(reads, "OPEN_BYTES", 1)
    paths = []
    for i, n in enumerate([9, 9, 9, 500, 9, 9, 0, 0, 90, 60]):
        (tmp_path / f"{i}.fa").write_text("x" * n)
        paths.append(str(tmp_path / f"{i}.fa"))
    parts = [[n for _, n in p.files] for p in reads._packed(paths, 5)]
    assert sum(parts, []) == list(range(5, 15)) and [8] in parts
    assert reads._packed([]) == []


def test_files_of_folders_come_once(tmp_path):
    for d in ("b", "a"):
        (tmp_path / d).mkdir()
        for n in ("2", "1"):
            (tmp_path / d / n).write_text("")
    got = reads.folder_files([str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "b")])
    assert [os.path.relpath(f, tmp_path) for f in got] == ["a/1", "a/2", "b/1", "b/2"]
