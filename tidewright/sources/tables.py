"""Sources: delimited tables, change feeds, dependency files, JSON lines and run configurations."""

from __future__ import annotations

import json
import logging
import string
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.cluster import with_position
from tidewright.functions.prepare import null_tokens
from tidewright.model import OrderDependency, parse, trivial

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    has_header: bool = False
    can_have_deletions: bool = False
    columns_to_include: tuple[str, ...] = ()


def letters(n: int) -> list[str]:
    """Names of columns without a header: A to Z, then _c26 and on."""
    return [string.ascii_uppercase[i] if i < 26 else f"_c{i}" for i in range(n)]


def header(spark: SparkSession, path: str, options: CsvOptions) -> list[str]:
    """The column names of a file. Blank names are left out, so later ones move forward; columns at the end without a
    name are called by their place. Repeated names are errors."""
    first = spark.read.csv(path, sep=options.delimiter, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).head()
    if first is None:
        raise ValueError(f"{path} is empty")
    meta = ["_op", "_rid"] if options.can_have_deletions else []
    n = len(first) - len(meta)
    if n < 0:
        raise ValueError(f"{path}: a change feed begins with an operation and a record id")
    if not options.has_header:
        return meta + letters(n)
    names = [x.strip() for x in first[len(meta) :] if (x or "").strip()]
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: repeated column names in {names}")
    return meta + names + [f"_c{i}" for i in range(len(names), n)]


def read_integers(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """The integer table of a delimited file; a cell that is none, blank ones too, or a row of another width fails the read."""
    names = header(spark, path, options)
    kinds = [T.StringType() if n == "_op" and options.can_have_deletions else T.LongType() for n in names]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    df = spark.read.csv(path, schema=schema, sep=options.delimiter, header=options.has_header, enforceSchema=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = project(df, options.columns_to_include, keep=("_op", "_rid") if options.can_have_deletions else ())
    blank = lambda c: F.raise_error(F.lit(f"{path}: a blank cell in column {c}")).cast("long")
    return df.withColumns({c: F.coalesce(F.col(c), blank(c)) for c in df.columns if c != "_op"})


def project(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns in the table's order; missing ones are logged, none at all is an error."""
    if not wanted:
        return df
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        log.warning("columns not in the table: %s", ", ".join(missing))
    found = [c for c in df.columns if c in wanted and c not in keep]
    if not found:
        raise ValueError("none of the wanted columns is in the table")
    return df.select(*keep, *found)


def read_changes(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """_op, _rid, _seq and the values: a change feed, or a plain table as inserts (with null _rid).

    _seq follows the order of the file, and of a folder's files by name; unknown operations and changes without a
    record fail the read.
    """
    df = read_integers(spark, path, options)
    if not options.can_have_deletions:
        df = df.select(F.lit("insert").alias("_op"), F.lit(None).cast("long").alias("_rid"), "*")
    known = F.lower(F.trim("_op"))
    op = F.when(known.isin("insert", "update", "delete"), known).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("_op", F.lit("null")))))
    values = [c for c in df.columns if c not in ("_op", "_rid")]
    out = df.select(op.alias("_op"), "_rid", F.monotonically_increasing_id().alias("_seq"), *values)
    if len(df.inputFiles()) < 2:
        return out
    # Spark packs several files by size, so their order is that of their names, and within one that of its lines
    placed = with_position(out.withColumn("_file", F.input_file_name()), [F.col("_file"), F.col("_seq")], "_place")
    return placed.withColumn("_seq", F.col("_place").cast("long")).drop("_file", "_place")


def numbered(changes: DataFrame, names: Sequence[str], first: int) -> tuple[DataFrame, int]:
    """The rows with an id in _tid: their record id where given, else their place behind first; and the first id that is free."""
    rows = changes.select(F.coalesce(F.col("_rid"), F.col("_seq") + F.lit(first)).alias("_tid"), *names)
    top = changes.agg(F.max(F.coalesce("_rid", F.col("_seq") + F.lit(first)))).first()[0]
    return rows, first if top is None else max(first, top + 1)


def read_raw(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """A text table with null tokens as nulls."""
    df = spark.read.csv(path, sep=delimiter, header=has_header)
    return null_tokens(df if has_header else df.toDF(*letters(len(df.columns))))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; lines that do not parse are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_ods(spark: SparkSession, path: str, names: Sequence[str]) -> set[OrderDependency]:
    """The dependencies of a text file, one a line; others are counted in the log."""
    lines = [r.value for r in spark.read.text(path).where("trim(value) <> ''").collect()]  # metadata
    found = [parse(x, names) for x in lines]
    if None in found:
        log.warning("%d lines of %s name no dependency of these columns", found.count(None), path)
    return {od for od in found if od is not None}


@dataclass(frozen=True)
class Config:
    """A run: data and expected results by phase, table options, and where to write."""

    initial: str | None = None
    increments: tuple[str, ...] = ()
    expected_initial: str | None = None
    expected_increments: tuple[str, ...] = ()
    csv: CsvOptions = field(default_factory=CsvOptions)
    deletion_mode: str = "none"
    output: str | None = None
    stats_path: str | None = None


#: Options that tune another engine and change no result; accepted and ignored.
TUNING = ("minMaxCacheThreshold", "optimizeBuildOrder", "partialCacheEviction", "showProgressBar", "skipRevalidationByInsert", "useEfficientUpdates", "useLazyList")


def _plain(options: dict, known: dict[str, str], what: str) -> dict:
    unknown = set(options) - set(known)
    if unknown:
        raise ValueError(f"unknown options of {what}: {sorted(unknown)}")
    return {known[k]: tuple(v) if isinstance(v, list) else v for k, v in options.items() if v is not None}


def load_config(source: str) -> Config:
    """The configuration in a JSON file, or in source itself if it begins with {."""
    text = source
    if not source.lstrip().startswith("{"):
        with open(source, encoding="utf-8") as f:
            text = f.read()
    raw = json.loads(text)
    if "data" not in raw:
        raise ValueError("a configuration needs data")
    data, results = raw["data"], raw.get("results", {})
    csv = CsvOptions(**_plain(raw.get("csv", {}), {"delimiter": "delimiter", "hasHeader": "has_header", "canHaveDeletions": "can_have_deletions", "columnsToInclude": "columns_to_include"}, "csv"))
    algorithm = dict(raw.get("algo", {}))
    mode = str(algorithm.pop("deletionMode", None) or "none").lower()
    _plain(algorithm, dict.fromkeys(TUNING, "_"), "algo")
    if mode not in ("none", "afterinsert", "deleteonly"):
        raise ValueError(f"deletionMode: {mode}")
    if csv.can_have_deletions and mode != "none":
        raise ValueError("a change feed has deletions of its own")
    return Config(data.get("initial"), tuple(data.get("increments", ())), results.get("initial"), tuple(results.get("increments", ())), csv, mode, raw.get("output"), raw.get("intermediateStatsPath"))


def config_json(config: Config) -> str:
    """The JSON text that load_config reads back."""
    csv = {"delimiter": config.csv.delimiter, "hasHeader": config.csv.has_header, "canHaveDeletions": config.csv.can_have_deletions, "columnsToInclude": list(config.csv.columns_to_include)}
    out = {"data": {"initial": config.initial, "increments": list(config.increments)}, "results": {"initial": config.expected_initial, "increments": list(config.expected_increments)}, "csv": csv, "algo": {"deletionMode": config.deletion_mode}, "output": config.output, "intermediateStatsPath": config.stats_path}
    return json.dumps(out, indent=2)


def start_of(spark: SparkSession, config: Config) -> tuple[DataFrame | None, list[str], set[OrderDependency] | None, int]:
    """The first table (_tid and values; None: empty), its value columns, its cover if known, and the first id that is free.

    Delete-only runs start with all files and the cover after the last; a run without a first table with the trivial cover.
    """
    paths = [p for p in ((config.initial, *config.increments) if config.deletion_mode == "deleteonly" else (config.initial,)) if p]
    if not paths and not config.increments:
        raise ValueError("a configuration names no table")
    first = read_changes(spark, paths[0] if paths else config.increments[0], config.csv)
    names = [c for c in first.columns if c not in ("_op", "_rid", "_seq")]
    if not paths:
        return None, names, trivial(len(names)), 0
    table, free = numbered(first, names, 0)
    for p in paths[1:]:
        more, free = numbered(read_changes(spark, p, config.csv), names, free)
        table = table.unionByName(more)
    expected = (config.expected_increments or (None,))[-1] if config.deletion_mode == "deleteonly" else config.expected_initial
    return table, names, read_ods(spark, expected, names) if expected else None, free
