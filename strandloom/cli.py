"""Command line: ``rphash`` fits planes, ``train`` trains vectors, ``train-parts`` does so from folders and writes files by rank, ``transform`` embeds reads."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.operators import embed, lsh, train
from strandloom.sources import files, reads


def _kind(a) -> str:
    if a.fasta and a.fastq:
        raise SystemExit("--fasta and --fastq exclude each other")
    return "fasta" if a.fasta else "fastq" if a.fastq else a.default_kind


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, default_kind: str):
        t = sub.add_parser(name)
        t.set_defaults(default_kind=default_kind)
        t.add_argument("--fasta", action="store_true")
        t.add_argument("--fastq", action="store_true")
        t.add_argument("--thread", type=int, default=0, help="cores to use, 0: all")
        return t

    t = tool("rphash", "auto")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-k", "--kmer-size", type=int, required=True)
    t.add_argument("--hash-size", type=int, required=True)
    t.add_argument("-o", "--output", default="rp.bin")
    t.add_argument("--seed", type=int, default=0)
    for name in ("train", "train-parts"):
        t = tool(name, "seqtext")
        t.add_argument("inputs", nargs="+")
        t.add_argument("--hash-file", required=True)
        t.add_argument("-o", "--output", default="model" if name == "train" else "output")
        t.add_argument("--lr", type=float, default=0.3)
        t.add_argument("--dim", type=int, default=300)
        t.add_argument("--half-window", type=int, default=5)
        t.add_argument("--neg-size", type=int, default=5)
        t.add_argument("--epoch", type=int, default=100)
        t.add_argument("--use-skipgram", action="store_true")
        t.add_argument("--init", choices=("random", "uniform"), default="random")
        t.add_argument("--seed", type=int, default=0)
        t.add_argument("--dense", action="store_true", help="draw negatives among all words of the hash, not those that occur")
        t.add_argument("--mode", choices=("local", "joined"), default="local")
        t.add_argument("--partitions", type=int, default=8)
        t.add_argument("--batch", type=int, default=1)
        t.add_argument("--shuffle", type=int, default=800, help="reads of a batch that is shuffled in each epoch, 0: none")
        t.add_argument("-z", "--zip", action="store_true")
        if name == "train-parts":
            t.add_argument("--ranks", type=int, default=8)
    t = tool("transform", "seqtext")
    t.add_argument("inputs", nargs="+")
    t.add_argument("--hash-file", required=True)
    t.add_argument("--vec", required=True, help="model folder of train, or a vector file")
    t.add_argument("-o", "--output", default="output.txt")
    t.add_argument("-z", "--zip", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{a.thread or '*'}]").appName(f"strandloom {a.tool}").getOrCreate()
    if a.tool == "rphash":
        lsh.build_planes(reads.load(spark, a.input, _kind(a)), a.kmer_size, a.hash_size, a.seed, keys=["file_idx", "rec_idx"]).save(a.output, spark)
        return
    planes = lsh.Planes.load(a.hash_file, spark)
    if a.tool == "train-parts":
        if bad := [x for x in a.inputs if not os.path.isdir(x)]:
            raise SystemExit(f"no folder: {bad[0]}")
        files.new_folder(a.output)
    rows = reads.load(spark, reads.folder_files(a.inputs) if a.tool == "train-parts" else a.inputs, _kind(a))
    hashed = lsh.hash_reads(rows, planes, ["file_idx", "rec_idx"])
    if a.tool != "transform":
        o = train.Options(planes.bits, a.dim, a.lr, a.half_window, a.neg_size, a.epoch, a.use_skipgram, a.init, a.seed, a.dense, a.partitions, a.mode, a.batch, shuffle=a.shuffle)
        model, losses = train.train(hashed, o)
        if a.tool == "train-parts":
            files.save_parts(model, a.output, 1 << planes.bits, a.ranks, a.dim, a.zip)
            return
        files.save_model(model, a.output, dim=a.dim, bits=planes.bits, losses=losses)
        files.save_counts(model.select("word", F.col("wc").alias("n")), f"{a.output}/wc.txt" + (".gz" if a.zip else ""))
        # Words that never occurred keep the vectors they would have started with.
        every = train.initial(spark.range(1 << planes.bits).withColumnRenamed("id", "word"), o)
        files.save_vectors(model, f"{a.output}/model.vec.bin" + (".gz" if a.zip else ""), size=1 << planes.bits, missing=every)
        return
    if os.path.isdir(a.vec):
        model, params = files.load_model(spark, a.vec)
        dim = params["dim"]
    else:
        model = files.load_vectors(spark, a.vec)
        dim = len(model.first().wi)
    files.save_embeddings(embed.mean_pool(hashed, model, ["file_idx", "rec_idx"], dim), a.output, ["file_idx", "rec_idx"], zipped=a.zip)


if __name__ == "__main__":
    main()
