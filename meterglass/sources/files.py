"""Where tools keep their session files, and reading those files with their paths.

Roots are read by Spark's readers, so they may be on any file system that Spark can open; those pass over
hidden folders below a root (a name beginning with . or _). A scan lists folders as Spark jobs, hidden ones
too, and counts those that can't be read.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.schema import COLUMNS, SOURCES
from meterglass.session import cut_lineage, ship_package
from meterglass.sources.logs import opened


@dataclass(frozen=True)
class Place:
    """A tool's root below the home folder and the names of its files."""

    root: str
    pattern: str


#: Fixed values: {data} is the XDG data folder, {codex} codex's own one.
PLACES = {
    "opencode": Place("{data}/opencode/storage/message", "*.json"),
    "claude": Place("{home}/.claude/projects", "*.jsonl"),
    "codex": Place("{codex}/sessions", "*.jsonl"),
    "gemini": Place("{home}/.gemini/tmp", "session-*.json"),
    "cursor": Place("{cache}/cursor-cache", "*.csv"),
    "amp": Place("{data}/amp/threads", "T-*.json"),
    "droid": Place("{home}/.factory/sessions", "*.settings.json"),
}


def roots(home: str, sources: list[str] | None = None, environ: dict[str, str] | None = None, cache: str | None = None) -> dict[str, str]:
    """source -> root for the named sources, all if None; an environment may move some of them."""
    env = os.environ if environ is None else environ
    names = {
        "home": home,
        "data": env.get("XDG_DATA_HOME") or f"{home}/.local/share",
        "codex": env.get("CODEX_HOME") or f"{home}/.codex",
        "cache": cache or f"{home}/.config/meterglass",
    }
    return {s: PLACES[s].root.format(**names) for s in SOURCES if sources is None or s in sources}


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def texts(spark: SparkSession, root: str | list[str], pattern: str, whole: bool = True) -> DataFrame:
    """Of a folder, or of the files of a list that have the pattern's names:
    path, modified (epoch ms), block, split and value: a row per file, or per line; none if the root is missing.

    ``block`` is where the part of the file begins that a line was read with; ``split`` says that it is not all of it.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    # Files that vanish or can't be read are passed over.
    reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    if isinstance(root, list):
        # Names are names, whatever characters of a pattern are in them.
        root = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in root if fnmatch.fnmatch(p.rpartition("/")[2], pattern)]
    try:
        rows = reader.text(root, wholetext=whole) if root else None
    except AnalysisException as e:
        if not _missing(e):
            raise
        rows = None
    if rows is None:
        return spark.createDataFrame([], "path string, modified bigint, block bigint, split boolean, value string")
    path = plain_path(F.col("_metadata.file_path"))
    modified = F.unix_millis("_metadata.file_modification_time").alias("modified")
    split = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    return rows.select(path.alias("path"), modified, F.col("_metadata.file_block_start").alias("block"), split.alias("split"), "value")


def plain_path(uri: Column) -> Column:
    """A file's path as it is named, not as a URI has it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, size and modified (epoch ms) of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        found = reader.load(root)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], "path string, size bigint, modified bigint")
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def walk(spark: SparkSession, where: dict[str, str]) -> DataFrame:
    """source, path, size, modified of every session file below the roots, and a row without size per folder that can't be read.

    Folders are listed level by level, those of a level by many tasks, hidden ones too; links to folders are
    not followed. A root that is missing has no files. Roots are local paths or URIs that Arrow can open.
    """
    patterns = {source: PLACES[source].pattern for source in where}

    def listed(batches):
        for batch in batches:
            out = []
            for source, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inside = opened(folder)
                scheme = folder.removesuffix(inside) if "://" in folder else ""
                local = isinstance(system, fs.LocalFileSystem)
                try:
                    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                except OSError:
                    out.append((source, folder, None, None, False))
                    continue
                for info in found:
                    if info.type == fs.FileType.Directory and not (local and os.path.islink(info.path)):
                        out.append((source, scheme + info.path, None, None, True))
                    elif info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, patterns[source]):
                        when = info.mtime_ns // 1_000_000 if info.mtime_ns is not None else 0
                        out.append((source, scheme + info.path if scheme else f"file://{info.path}", info.size, when, False))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "path", "size", "modified", "folder"])

    ship_package(spark)
    level = spark.createDataFrame(list(where.items()), "source string, path string")
    found, tasks = None, spark.sparkContext.defaultParallelism
    while True:
        level = cut_lineage(level.repartition(tasks, "source", "path").mapInArrow(listed, "source string, path string, size bigint, modified bigint, folder boolean"))
        files = level.filter("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        level = level.filter("folder").select("source", "path")
        if level.isEmpty():
            return found


def scan_stats(spark: SparkSession, where: dict[str, str]) -> DataFrame:
    """source, files, unreadable (folders that could not be listed) for each root, zero where there are none."""
    counts = walk(spark, where).groupBy("source").agg(F.count("size").alias("files"), F.count_if(F.col("size").isNull()).alias("unreadable"))
    places = spark.createDataFrame([(s,) for s in where], "source string")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("files", "unreadable")}
    return places.join(counts, "source", "left").withColumns(zero).select("source", "files", "unreadable")


def tagged_listing(spark: SparkSession, where: dict[str, str]) -> DataFrame:
    """source, path of every file of all roots."""
    return walk(spark, where).filter("size is not null").select("source", "path")


def is_graph_document(document: Column) -> Column:
    """Whether a JSON text has a graph's form: meta and summary of a composite type or null, years and contributions arrays."""
    v = F.try_parse_json(document)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    composite = lambda name: kind(name).rlike("^(OBJECT|ARRAY|VOID)")
    lists = kind("years").startswith("ARRAY") & kind("contributions").startswith("ARRAY")
    return composite("meta") & composite("summary") & lists


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def decoded(rows: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """``rows`` with ``r``, the JSON of a column; without those that are no JSON of the schema.

    A value of a wrong type makes the whole record unusable, as a strict decoder has it.
    """
    kind = T.StructType.fromDDL(f"{schema}, _corrupt string")
    r = F.from_json(value, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    usable = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.trim(F.col(value)).startswith("{")
    return rows.withColumn("r", r).filter(usable)


def messages(rows: DataFrame, **columns: Column | str | None) -> DataFrame:
    """The relation of messages from named columns; what isn't named is 0 or null. The path of ``rows`` goes along."""
    out = [F.col("path")] if "path" in rows.columns else []
    for c in COLUMNS:
        kind = {"timestamp_ms": "bigint", "date": "date", "cost": "double"}.get(c, "string")
        if c in ("input", "output", "cache_read", "cache_write", "reasoning"):
            out.append(F.coalesce(columns.get(c, F.lit(0)), F.lit(0)).cast("bigint").alias(c))
        elif c == "date":
            out.append(F.timestamp_millis(columns["timestamp_ms"]).cast("date").alias(c))
        elif c == "cost":
            out.append(F.nanvl(F.coalesce(columns.get(c, F.lit(0.0)), F.lit(0.0)).cast("double"), F.lit(0.0)).alias(c))
        else:
            value = columns.get(c)
            out.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(c))
    return rows.select(*out)
