"""The command line: python -m glyphflow, or this file under spark-submit.

    [-c CONFIG | --from R --to R | --auto [--target R]] [options] [FILE...]
    info CONFIG
    detect [-0] [--files-from PATH] [FILE...]

Files and folders lie in any store that Spark reads; "-", or none, is standard
input. In folders links are skipped, and, as by Spark's readers, names that
begin with a dot or an underscore. Every error ends with status 1; detect logs
files that can't be read, and goes on.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import conversion
from glyphflow.functions.detection import detect_bytes
from glyphflow.plans import configs
from glyphflow.sources import arpa, files
from glyphflow.sources.dictionaries import MissingDictionary, Registry

VERSION = "0.1"
DEFAULT_CONFIG = "s2t"
SAMPLE = "裏面的漢字，万与弁当，鼠标软件"


class Refused(Exception):
    """A wrong argument or input."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Refused(message)


def _listing(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--files-from", metavar="PATH", help="paths from a file, or from standard input if -")
    parser.add_argument("-0", "--null", action="store_true", help="listed paths are separated by NUL")
    parser.add_argument("-V", "--version", action="version", version=f"glyphflow {VERSION}")
    parser.add_argument("files", nargs="*", metavar="FILE")


def converting_parser() -> argparse.ArgumentParser:
    parser = _Parser(prog="glyphflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    parser.add_argument("-c", "--config", help=f"one of {' '.join(configs.CONFIGS)}; default {DEFAULT_CONFIG}")
    parser.add_argument("--from", dest="source", metavar="REGION")
    parser.add_argument("--to", dest="to", metavar="REGION")
    parser.add_argument("--auto", action="store_true", help="detect each input's variant and convert it to --target")
    parser.add_argument("--target", metavar="REGION", help="with --auto; default cn-s")
    parser.add_argument("--dict", action="append", default=[], metavar="FILE", help="custom words, key<TAB>value; may be repeated")
    parser.add_argument("--dictionaries", metavar="DIR", help="folder of <name>.txt dictionaries; default: $GLYPHFLOW_DICTIONARIES")
    parser.add_argument("--stand-ins", action="store_true", help="for dictionaries between Simplified and Traditional that are lacking, take CLDR's rules")
    parser.add_argument("--ngram", metavar="FILE", help="ARPA model; by itself it means --trigram")
    for mode, value in (("--fast", "off"), ("--bigram", "bigram"), ("--trigram", "trigram")):
        parser.add_argument(mode, dest="mode", action="store_const", const=value)
    parser.add_argument("-i", "--in-place", action="store_true", help="rewrite each file")
    parser.add_argument("-o", "--output", metavar="PATH", help="write a Parquet table (path, text) instead of standard output")
    parser.add_argument("-l", "--list", "--ls", action="store_true", help="list regions and conversions")
    _listing(parser)
    return parser


def detecting_parser() -> argparse.ArgumentParser:
    parser = _Parser(prog="glyphflow detect", allow_abbrev=False)
    _listing(parser)
    return parser


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """The arguments, if they go together."""
    for wrong, why in (
        ((args.source is None) != (args.to is None), "--from and --to go together"),
        (args.target is not None and not args.auto, "--target is for --auto"),
        (args.target is not None and args.to is not None, "--target and --to exclude each other"),
        (args.config is not None and args.source is not None, "--config and --from/--to exclude each other"),
        (args.mode in ("bigram", "trigram") and not args.ngram, f"--{args.mode} needs --ngram"),
        (args.in_place and args.output is not None, "--in-place and --output exclude each other"),
    ):
        if wrong:
            raise Refused(why)
    args.mode = args.mode or ("trigram" if args.ngram else "off")
    return args


def listing() -> str:
    """The regions and the conversions between them."""
    rows = [("REGION", "DESCRIPTION"), *configs.REGIONS.items(), (), ("FROM", "TO", "CONFIG"), *((s, t, c) for (s, t), c in configs.PAIRS.items())]
    return "".join("  ".join(f"{x:<6}" for x in row).rstrip() + "\n" for row in rows)


def information(config: str, registry: Registry | None = None) -> str:
    """What a config is, and what it makes of a sample."""
    description, source, target, _, _ = configs.CONFIGS[configs.parse_config(config)]
    lacking = configs.missing(config, registry)
    sample = f"needs: {', '.join(lacking)}" if lacking else f"out: {configs.resolve(config, registry).convert(SAMPLE)}"
    return f"Config:      {config}\nDescription: {description}\nFrom:        {source}\nTo:          {target}\n\nExample:\n  in:  {SAMPLE}\n  {sample}\n"


def custom_words(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(key, first value) of custom dictionaries, in order of files and lines."""
    out = []
    for path in paths:
        for line in spark.read.text(path, wholetext=True).first()[0].split("\n"):
            key, tab, values = line.partition("\t")
            if tab and not line.startswith("#") and values.split():
                out.append((key, values.split()[0]))
    return out


def _paths(spark: SparkSession, args: argparse.Namespace, stdin) -> list[str]:
    """The listed paths; each mention of standard input is one with the first."""
    listed: list[str] = []
    if args.files_from == "-":
        texts = stdin.read().split(b"\0" if args.null else b"\n")
        listed = [p for x in texts if (p := x.decode("utf-8", "replace").strip())]
    elif args.files_from:
        listed = files.listed_paths(spark, args.files_from, args.null)
    return listed


def _once(paths: list[str]) -> list[str]:
    first = paths.index("-") if "-" in paths else len(paths)
    return [p for k, p in enumerate(paths) if p != "-" or k == first] or ["-"]


def _contents(spark: SparkSession, paths: list[str], stdin, lenient: bool = False) -> DataFrame:
    """(place, path, shown, content) of the paths' files, "-" being standard input."""
    out, named = None, [p for p in paths if p != "-"]
    if named:
        found = files.in_order(files.read_bytes(spark, *dict.fromkeys(named), lenient=lenient), paths)
        out = found.select("place", "path", "shown", "content")
    if "-" in paths:
        said = spark.createDataFrame([(paths.index("-"), "-", "-", bytearray(stdin.read()))], "place int, path string, shown string, content binary")
        out = said if out is None else out.unionByName(said)
    return out


def detect(spark: SparkSession, argv: list[str], stdin, stdout, stderr) -> int:
    """region, confidence and path of each input, tab-separated; paths that aren't there are named and count as an error."""
    args = detecting_parser().parse_args(argv)
    paths = _once(_paths(spark, args, stdin) if args.files_from else args.files)
    gone = [p for p in paths if p != "-" and not files.qualified(spark, p)[1]]
    for p in gone:
        print(f"glyphflow detect: {p}: no such file or folder", file=stderr)
    paths = [p for p in paths if p not in gone]
    if paths:
        found = _contents(spark, paths, stdin, lenient=True).select("place", "path", "shown", detect_bytes("content").alias("d"))
        found = found.orderBy("place", "path").select("shown", F.coalesce("d.region", F.lit("unknown")).alias("r"), F.coalesce("d.confidence", F.lit(0)).alias("c"))
        for row in found.toLocalIterator():
            stdout.write(f"{row['r']}\t{row['c']}\t{row['shown']}\n".encode())
    return int(bool(gone))


def convert(spark: SparkSession, args: argparse.Namespace, stdin, stdout) -> int:
    registry, custom = Registry(root=args.dictionaries, stand_ins=args.stand_ins), custom_words(spark, args.dict) or None
    ngrams = arpa.read(spark, args.ngram) if args.mode != "off" else None
    text = F.col("content").cast("string")
    if args.auto:
        converted = conversion.convert_auto("text", configs.parse_region(args.target or "cn-s"), registry, custom=custom, ngrams=ngrams, mode=args.mode)
    else:
        config = configs.config_for(args.source, args.to) if args.source else configs.parse_config(args.config or DEFAULT_CONFIG)
        converted = conversion.convert("text", config, custom, ngrams, args.mode, registry)
    paths = _once([*args.files, *_paths(spark, args, stdin)])
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")
    rows = _contents(spark, paths, stdin).select("place", "path", F.when(F.is_valid_utf8(text), text).otherwise(bad).alias("text"))
    done = rows.select("place", "path", converted.alias("text"))
    if args.output:
        done.select("path", "text").write.mode("errorifexists").parquet(args.output)
        return 0
    if args.in_place:
        files.write_in_place(done.where("path <> '-'").dropDuplicates(["path"]))
        done = done.where("path = '-'") if "-" in paths else done.limit(0)
    for row in done.orderBy("place", "path").toLocalIterator():
        stdout.write(row["text"].encode())
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=None, stdout=None, stderr=None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    stdin, stdout, stderr = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer, stderr or sys.stderr
    session = lambda: spark or SparkSession.builder.appName("glyphflow").getOrCreate()
    try:
        if argv[:1] == ["detect"]:
            return detect(session(), argv[1:], stdin, stdout, stderr)
        if argv[:1] == ["info"]:
            if len(argv) != 2:
                raise Refused("info takes the name of a config")
            stdout.write(information(argv[1]).encode())
            return 0
        args = checked(converting_parser().parse_args(argv))
        if args.list:
            stdout.write(listing().encode())
            return 0
        return convert(session(), args, stdin, stdout)
    except SystemExit as e:  # --help and --version
        return int(e.code or 0)
    except (Refused, ValueError, OSError, MissingDictionary) as e:
        print(f"glyphflow: {e}", file=stderr)
    except Exception as e:  # what Spark raises of inputs
        print(f"glyphflow: {str(e).strip().splitlines()[0]}", file=stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
