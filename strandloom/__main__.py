"""Command line: ``python -m strandloom COMMAND``. Tables are Parquet folders, reports tab-separated text folders."""

from __future__ import annotations

import argparse
import sys
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom import __version__
from strandloom.functions.bases import parse_number
from strandloom.operators import compare, lookup, quality, regions, sexchr, table as tables, trio
from strandloom.operators.options import CountOptions, PartitionOptions, QualityOptions, RegionOptions, TrioOptions
from strandloom.sources import reports
from strandloom.sources.sequences import read_fastx, read_report, records


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str, many: str | None = None, out: bool = True):
        p = sub.add_parser(name)
        for i in inputs:
            p.add_argument(i)
        if many:
            p.add_argument(many, nargs="+")
        if out:
            p.add_argument("-o", "--out", required=True)
        return p

    p = command("count", many="inputs")
    p.add_argument("-k", type=int, default=31)
    p.add_argument("-b", "--min2", action="store_true", help="keep only k-mers seen twice or more; a second input is then the one counted")
    command("recount", "table", "input")
    p = command("cntasm", many="inputs")
    p.add_argument("-k", type=int, default=31)
    p.add_argument("-c", dest="low", type=int, default=1)
    p.add_argument("-x", dest="high", type=int, default=1)
    p.add_argument("-e", dest="max_out", type=int, default=0)
    p.add_argument("-i", dest="seed")
    command("subtract", "left", "right")
    command("isec", "left", many="others")
    p = command("print", "table")
    p.add_argument("-c", dest="counts", action="store_true")
    p = command("qv", "table", "input")
    p.add_argument("-l", dest="min_len", type=parse_number, default=0)
    p.add_argument("-f", dest="min_frac", type=float, default=0.5)
    p.add_argument("-e", dest="fpr", type=float, default=4e-5)
    p.add_argument("-p", dest="each", action="store_true")
    p.add_argument("-E", dest="absent", action="store_true")
    for name in ("triobin", "trioeval"):
        p = command(name, "pat", "mat", "input")
        p.add_argument("-c", dest="min_count", type=int, default=2)
        p.add_argument("-d", dest="mid_count", type=int, default=5)
        if name == "triobin":
            p.add_argument("-p", dest="diff", action="store_true")
            p.add_argument("-r", dest="ratio", type=float, default=0.33)
        else:
            p.add_argument("-n", dest="min_streak", type=int, default=2)
            p.add_argument("-e", dest="errors", action="store_true")
            p.add_argument("-F", dest="frags", action="store_true")
    p = command("inspect", "table", many=None)
    p.add_argument("other", nargs="?")
    p.add_argument("-m", dest="max_count", type=int, default=20)
    p = command("chkerr", "table", "input")
    p.add_argument("-c", dest="min_count", type=int, default=3)
    p.add_argument("-s", dest="min_streak", type=int, default=5)
    command("sexchr", "first", "second", "shared", "hap1", "hap2")
    p = command("groupxy", "report")
    for flag, name, value in (("-s", "min_sex", 0.7), ("-c", "min_specific", 0.3), ("-r", "min_ratio", 0.9)):
        p.add_argument(flag, dest=name, type=float, default=value)
    sub.add_parser("version")
    return top


def k_of(spark, *paths: str) -> int:
    """The k that all tables have."""
    k = tables.same_k(*(tables.load_parquet(spark, p) for p in paths))
    if k is None:
        raise ValueError(f"{', '.join(paths)}: no table says its k")
    return k


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder, or of standard input if the path is ``-``; those are parsed by the driver and should be few."""
    if path != "-":
        return read_fastx(spark, path)
    rows = [(n, s, q, len(s), i) for i, (n, s, q) in enumerate(records(sys.stdin))]
    return spark.createDataFrame(rows, "name string, seq string, qual string, len int, seq_id long")


def run(args, spark: SparkSession) -> list[DataFrame]:
    """The report's parts in order; tables are written here."""
    load = lambda p: tables.load_parquet(spark, p)
    line = reports.lines
    match args.command:
        case "count":
            opt = CountOptions(args.k, 2 if args.min2 else 1)
            first = sequences(spark, args.inputs[0])
            two = args.min2 and len(args.inputs) > 1
            if len(args.inputs) > 1 and not two:
                warnings.warn("without -b only the first input is counted", stacklevel=2)
            tables.save_parquet(tables.count_two(first, sequences(spark, args.inputs[1]), opt.k) if two else tables.count(first, opt.k, opt.min_count), args.out, opt.k)
        case "recount":
            k = k_of(spark, args.table)
            tables.save_parquet(tables.recount(load(args.table), sequences(spark, args.input), k), args.out, k)
        case "cntasm":
            every = reduce(DataFrame.unionAll, [sequences(spark, p).withColumn("sample", F.lit(i)) for i, p in enumerate(args.inputs)])
            seed = load(args.seed) if args.seed else None
            tables.save_parquet(tables.collate(every, args.k, args.low, args.high, args.max_out, seed, n_samples=len(args.inputs)), args.out, args.k)
        case "subtract":
            tables.save_parquet(tables.subtract(load(args.left), load(args.right)), args.out, k_of(spark, args.left, args.right))
        case "isec":
            tables.save_parquet(tables.intersect(load(args.left), *map(load, args.others)), args.out, k_of(spark, args.left, *args.others))
        case "print":
            return [line(tables.listing(load(args.table), args.counts))]
        case "qv":
            k, opt, table, seqs = k_of(spark, args.table), QualityOptions(args.min_len, args.min_frac, args.fpr), load(args.table), sequences(spark, args.input)
            spec = quality.spectrum(seqs, table, k, opt).withColumn("grp", F.lit(1))
            got = quality.solve_groups(spec, k, opt.fpr).withColumns({"fl": F.format_string("%.3g", "fpr_lower"), "fu": F.format_string("%.3g", "fpr_upper")})
            bins = spec.join(got.select("grp", F.posexplode("adj").alias("c", "adj")), ["grp", "c"]).orderBy(F.desc("c"))
            told = ["CT\tcount, k-mers of the table, k-mers of the sequences, the same adjusted", "FR\tfalse positive rate, lower and upper bound"]
            told += ["ER\tk-mers of the sequences, those in error", "CV\tcoverage", "QV\tquality of all k-mers, the same adjusted"]
            out = [spark.createDataFrame([(f"CC\t{x}",) for x in told], "value string").coalesce(1)]
            out += [line(quality.absent_kmers(seqs, table, k, opt), "EK", ["name", "start"])] if args.absent else []
            out += [line(quality.per_sequence(seqs, table, k, opt), "SQ", ["name", "len", "tot", "non0", "qv"])] if args.each else []
            three = {"qv_raw": "%.3f", "qv": "%.3f"}
            return [*out, line(bins, "CT", ["c", "hist", "cnt", "adj"]), line(got, "FR", ["fl", "fu"]), line(got, "ER", ["tot", "err"]), line(got, "CV", ["cov"]), line(got, "QV", ["qv_raw", "qv"], three)]
        case "triobin" | "trioeval":
            k, names = k_of(spark, args.pat, args.mat), {n: v for n, v in vars(args).items() if n in ("min_count", "mid_count", "ratio", "min_streak")}
            opt, seqs = TrioOptions(**names), sequences(spark, args.input)
            flags = lookup.trio_flags(load(args.pat), load(args.mat), opt)
            if args.command == "triobin":
                out = [line(trio.differences(seqs, flags, k), "D", ["name", "pos", "pat", "mat"])] if args.diff else []
                return [*out, line(trio.binning(seqs, flags, k, opt), None, ["name", "type", "sc0", "sc1", "c2", "c8", "c1", "c4", "nk", "c0"])]
            per = trio.phasing(seqs, flags, k, opt)
            out = [line(trio.phase_errors(seqs, flags, k, opt), "E", ["name", "pos", "prev", "cur"])] if args.errors else []
            out += [line(trio.fragments(seqs, flags, k, opt), "F", ["name", "type", "st", "en", "n"])] if args.frags else []
            return [*out, line(per, "S", ["name", "d0", "d1", "c00", "c01", "c10", "c11", "len"]), line(trio.phasing_totals(per), None, ["kind", "num", "den", "rate"])]
        case "inspect":
            if not args.other:
                return [line(compare.histogram_rows(load(args.table)).orderBy(F.desc("c")), "HS")]
            k, a, b = k_of(spark, args.table, args.other), load(args.table), load(args.other)
            part = lambda x: F.format_string("%.4f", x["frac"])
            sn = compare.sensitivity(a, b, args.max_count).groupBy("c", "tot", "hist").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "frac"))), part), "\t").alias("fracs"))
            qv = compare.qualities(a, b, k, args.max_count).orderBy(F.desc("c"))
            return [line(sn.orderBy(F.desc("c")), "SN"), line(qv, "QV", formats={"qv_raw": "%.3f", "qv": "%.3f"})]
        case "chkerr":
            opt = RegionOptions(args.min_count, args.min_streak)
            return [line(regions.low_support(sequences(spark, args.input), load(args.table), k_of(spark, args.table), opt), None, ["name", "start", "end", "streak"])]
        case "sexchr":
            three = (args.first, args.second, args.shared)
            both = sequences(spark, args.hap1).withColumn("hap", F.lit(1)).unionAll(sequences(spark, args.hap2).withColumn("hap", F.lit(2)))
            both = both.withColumn("seq_id", F.struct("hap", "seq_id"))
            rows = sexchr.sex_counts(both, lookup.set_flags(*map(load, three)), k_of(spark, *three)).withColumn("part", F.lit(0))
            return [line(rows, "S", ["name", "hap", "part", "nk", "ns", "n1", "n2"])]
        case "groupxy":
            rows = read_report(spark, args.report, "S", "name string, hap int, part int, nk long, ns long, n1 long, n2 long").drop("part")
            return [line(sexchr.partition(rows, PartitionOptions(args.min_sex, args.min_specific, args.min_ratio)), "S", ["name", "hap", "part", "nk", "ns", "n1", "n2"])]
    return []


def main(argv=None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return
    spark = spark or SparkSession.builder.appName(f"strandloom {args.command}").getOrCreate()
    for i, part in enumerate(run(args, spark)):
        part.write.mode("append" if i else "overwrite").text(args.out)


if __name__ == "__main__":
    main()
