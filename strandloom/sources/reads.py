"""Reading sequence files as DataFrames.

``load`` reads files on a file system that all machines mount, through a Python data source (formats fasta, fastq,
seqtext, auto), with the exact record semantics and numbers; files are packed into partitions of near-equal bytes. ``scan``
reads through Spark's own file sources, so from any store, splits large plain files, and orders records by (file, block,
row); use it at scale. Streams likewise: the formats read new files of a mounted folder, ``stream_fasta`` those of any store.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from strandloom.functions.seq import normalize_sequence
from strandloom.sources import records
from strandloom.storage import local

SCHEMA = "file STRING, file_idx INT, rec_idx BIGINT, id STRING, seq STRING"


def expand(paths: list[str]) -> list[str]:
    """Files named, in order; a folder stands for its files, sorted; a missing one is an error."""
    out: list[str] = []
    for p in map(local, paths):
        if os.path.isdir(p):
            out += sorted({f for f in glob.glob(os.path.join(p, "*")) if os.path.isfile(f)})
        elif os.path.exists(p):
            out.append(p)
        else:
            raise FileNotFoundError(p)
    return out


def folder_files(folders: list[str]) -> list[str]:
    """Files of folders in one order, each once, whichever folder names it."""
    return sorted({os.path.realpath(f) for f in expand(folders)})


def _paths(options: dict) -> list[str]:
    if options.get("paths"):
        return json.loads(options["paths"])
    return [options["path"]]


#: Bytes of a partition of files, and what opening a file counts besides its own.
PART_BYTES, OPEN_BYTES = 32 << 20, 64 << 10


class _Files(InputPartition):
    """(path, number) of files that follow each other."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _packed(paths: list[str], first: int = 0) -> list[_Files]:
    """Partitions of near-equal bytes, in order; a file is never split."""
    costs = [os.path.getsize(p) + OPEN_BYTES for p in paths]
    parts = max(1, -(-sum(costs) // PART_BYTES))
    share, out, before = sum(costs) / parts, {}, 0
    for i, (path, cost) in enumerate(zip(paths, costs)):
        # A file goes where its middle falls.
        out.setdefault(min(parts - 1, int((before + cost / 2) / share)), []).append((path, first + i))
        before += cost
    return [_Files(out[k]) for k in sorted(out)]


def _rows(options: dict, kind: str, part: _Files):
    lenient = str(options.get("mode", "FAILFAST")).upper() == "PERMISSIVE"
    stop = str(options.get("stop_at_blank", "true")).lower() == "true"
    for path, number in part.files:
        for i, (name, seq) in enumerate(records.read(path, kind, lenient, stop)):
            yield path, number, i, name, seq


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.options, self.kind = options, kind

    def partitions(self):
        return _packed(expand(_paths(self.options))) or [_Files([])]

    def read(self, partition):
        yield from _rows(self.options, self.kind, partition)


class _StreamReader(DataSourceStreamReader):
    """New files of a folder, whatever their times and names: an offset is the log of all files seen so far.

    What two offsets differ by is read, oldest first, so a file is read once, also after a restart from the checkpoint; a
    folder's files count by name, and names that begin with "_" or "." are left out. Files must be moved in whole. Offsets
    grow with the number of files (names are compressed): for millions of them use ``stream_fasta``.
    """

    def __init__(self, options: dict, kind: str):
        self.options, self.kind, self.seen = options, kind, {}

    @staticmethod
    def _offset(files: dict[str, int]) -> dict:
        names = zlib.compress(json.dumps(sorted(files.items(), key=lambda f: f[::-1])).encode())
        return {"count": len(files), "log": base64.b64encode(names).decode()}

    @staticmethod
    def _files(offset: dict) -> dict[str, int]:
        return dict(json.loads(zlib.decompress(base64.b64decode(offset["log"])))) if offset["count"] else {}

    def initialOffset(self):
        return self._offset({})

    def latestOffset(self):
        """Each file with the number of the offset that first held it, so that earlier ones keep their order."""
        turn = max(self.seen.values(), default=-1) + 1
        there = [p for p in expand(_paths(self.options)) if os.path.basename(p)[0] not in "._"]
        self.seen |= {p: turn for p in there if p not in self.seen}
        return self._offset(self.seen)

    def partitions(self, start, end):
        before, after = self._files(start), self._files(end)
        self.seen = after | self.seen
        new = [p for p in after if p not in before and os.path.exists(p)]
        return _packed(sorted(new, key=lambda p: (os.stat(p).st_mtime_ns, p)), len(before))

    def commit(self, end):
        self.seen = self._files(end) | self.seen

    def read(self, partition):
        yield from _rows(self.options, self.kind, partition)


def _source(kind: str, title: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(dict(self.options), kind)

        def streamReader(self, schema):
            return _StreamReader(dict(self.options), kind)

    return Source


SOURCES = [_source("fasta", "fasta"), _source("fastq", "fastq"), _source("seqtext", "seqtext"), _source("auto", "sequences")]


def register(spark: SparkSession) -> None:
    """Formats fasta, fastq, seqtext and sequences (by suffix) for ``spark.read`` and ``spark.readStream``."""
    for s in SOURCES:
        spark.dataSource.register(s)


def load(spark: SparkSession, paths: str | list[str], kind: str = "auto", **options) -> DataFrame:
    """file, file_idx, rec_idx, id, seq. Options: mode FAILFAST or PERMISSIVE, stop_at_blank."""
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    expand(paths)
    reader = spark.read.format("sequences" if kind == "auto" else kind).option("paths", json.dumps(paths))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def _place() -> list:
    """Where a row stands: file, first byte of its split, number in its task (which grows along a split)."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]


def scan_fasta(spark: SparkSession, paths: str | list[str], checked: bool = True) -> DataFrame:
    """file, block, row, id, seq. Records are parted at '>' at a line's beginning (without blanks before it).

    A record without a header, which only a file's first can be, ends the query unless ``checked`` is off, which drops it.
    """
    return _fasta(spark.read.option("lineSep", "\n>").text(paths).select(*_place(), F.col("value")), checked)


def _fasta(raw: DataFrame, checked: bool) -> DataFrame:
    """Records from what stands between the beginnings of headers: file, block, row, value."""
    # Only a file's first record keeps its '>': the others' went with what parts them. Rows count up within a split.
    firsts = raw.where("block = 0").groupBy("file").agg(F.min("row").alias("_first"))
    rows = raw.join(firsts, "file", "left").withColumn("_first", (F.col("block") == 0) & F.col("row").eqNullSafe(F.col("_first")))
    headless = F.col("_first") & ~F.col("value").startswith(">")
    blank = F.regexp_replace("value", r"\s", "") == ""
    if checked:
        value = F.when(headless & ~blank, F.raise_error(F.lit("a sequence stands before the first header"))).otherwise(F.col("value"))
        rows = rows.where(~(headless & blank)).withColumn("value", value)
    else:
        rows = rows.where(~headless)
    rows = rows.withColumn("value", F.when(F.col("_first"), F.expr("substring(value, 2)")).otherwise(F.col("value")))
    cut = F.instr("value", "\n")
    head = F.when(cut > 0, F.expr("substring(value, 1, instr(value, '\n') - 1)")).otherwise(F.col("value"))
    body = F.when(cut > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s+|\s+$", ""), r"[\r\n]", "")
    return rows.select("file", "block", "row", F.concat(F.lit(">"), F.regexp_replace(head, r"^\s+|\s+$", "")).alias("id"), normalize_sequence(plain).alias("seq"))


def stream_fasta(spark: SparkSession, path: str, sink, checked: bool = True):
    """A stream of the FASTA files that come into a folder, from any store; Spark keeps the log of files in the query's checkpoint.

    ``sink(records, number)`` gets each micro-batch as ``scan_fasta`` gives it; a batch that is tried again has the same number
    and files, so a sink that writes by number writes once. Returns the writer of the stream, to be started.
    """
    raw = spark.readStream.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def step(batch: DataFrame, number: int) -> None:
        sink(_fasta(batch.withColumn("row", F.monotonically_increasing_id()), checked), number)

    return raw.writeStream.foreachBatch(step)


def scan_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block, row, id, seq. Lines are numbered within each split of a file, and splits by sums over the counts of those before."""
    raw = spark.read.text(paths).select(*_place(), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("_c"))
    before = counts.select("file", "block", F.coalesce(F.sum("_c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    lines = raw.withColumn("n", own).join(before, ["file", "block"]).select("file", "block", "row", "line", (F.col("n") + F.col("_before")).alias("n"))
    held = lines.groupBy("file", F.floor(F.col("n") / 4).alias("rec")).agg(F.min(F.struct("block", "row")).alias("at"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    part = lambda i: F.get("l", F.lit(i))["line"]
    ok = (F.size("l") == 4) & part(0).startswith("@") & part(2).startswith("+")
    return held.select("file", "at.block", "at.row", F.when(ok, part(0)).otherwise(F.raise_error(F.lit("not a FASTQ record"))).alias("id"), normalize_sequence(part(1)).alias("seq"))


def scan_text(spark: SparkSession, paths: str | list[str], stop_at_blank: bool = True) -> DataFrame:
    """file, block, row, id, seq: a record for each line; of each file, up to its first blank line, or without blank lines.

    Where a file's first blank line stands is found by a sum over the file's blank lines alone.
    """
    raw = spark.read.text(paths).select(*_place(), F.col("value"))
    rows = raw.select("file", "block", "row", F.lit(records.TEXT_ID).alias("id"), normalize_sequence("value").alias("seq"), (F.col("value") == "").alias("_blank"))
    if stop_at_blank:
        ends = rows.where("_blank").groupBy("file").agg(F.min(F.struct("block", "row")).alias("_end"))
        rows = rows.join(ends, "file", "left").where(F.col("_end").isNull() | (F.struct("block", "row") < F.col("_end"))).drop("_end")
    return rows.where(~F.col("_blank")).drop("_blank")


def labels_from_id(ids, field: int, separator: str = "-"):
    """The part of a record's id at ``field``, as tutorials label reads by it."""
    return F.get(F.split(ids, separator), F.lit(field))
