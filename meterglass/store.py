"""Tables that are merged into, without a database: immutable folders behind an atomic pointer.

A store has tables that share a key. Rows are kept in buckets by the key's hash, each a folder of Parquet
files that is never changed. A version is a small file that says which folder each bucket of each table
is in; the newest one is live. A merge reads the buckets that it touches, writes those anew into a folder
of its own, and then renames one file: before that nothing has happened, after it all has. Buckets that
it doesn't touch are neither read nor written.

If another merge came first, the rename fails and the merge is done again on what the other left. A
version remembers the last batch of each stream, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Merges that may come first before one gives up.
TRIES = 8


class Files:
    """The file system of a folder, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.gateway = spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing if it is missing."""
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def appear(self, name: str, text: str) -> bool:
        """A file with this text is there at once and whole; False if there was one of the name."""
        hidden = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.context.rename(self.path(self.qualified(hidden)), self.path(self.qualified(name)), options)
            return True
        except Py4JJavaError as e:
            self.fs.delete(self.path(hidden), False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def qualified(self, name: str) -> str:
        return self.fs.makeQualified(self.path(name)).toString()

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


@dataclass(frozen=True)
class Store:
    """``tables`` maps a name to its schema (DDL), in which ``key`` is a column."""

    spark: SparkSession
    root: str
    tables: dict[str, str]
    key: str = "user_id"
    buckets: int = 64

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def live(self) -> dict:
        """The newest version: its number, the folder of each table's buckets, and the last batch of each stream."""
        numbers = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "tables": {t: {} for t in self.tables}, "batches": {}}
        found = json.loads(self.files.text(f"{self.root}/versions/{numbers[-1]}"))
        if found["buckets"] != self.buckets:
            raise ValueError(f"the store has {found['buckets']} buckets, not {self.buckets}")
        return found

    def read(self, table: str, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows in the live or the given version, of all or some buckets."""
        held = (version or self.live())["tables"].get(table, {})
        folders = [f"{self.root}/data/{f}/{table}/bucket={b}" for b, f in sorted(held.items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(*folders)

    def merge(self, keys: DataFrame, how: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], batch: tuple[str, int] | None = None) -> int:
        """Replace the rows of the buckets that ``keys`` fall into by what ``how`` makes of them; the version it is in.

        ``how`` takes and gives whole tables of those buckets. ``batch`` is a stream's name and the number
        of its batch: one that is not newer than the last is done already.
        """
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())
        for _ in range(TRIES):
            live = self.live()
            if batch and live["batches"].get(batch[0], -1) >= batch[1]:
                return live["version"]
            folder = f"v{live['version'] + 1:09d}-{uuid.uuid4().hex[:12]}"
            new = self._written(how({t: self.read(t, live, touched) for t in self.tables}), live, touched, folder)
            if batch:
                new["batches"] = live["batches"] | {batch[0]: batch[1]}
            if self._switch(new):
                return new["version"]
        raise RuntimeError(f"{TRIES} other merges came first")

    def _written(self, made: dict[str, DataFrame], live: dict, touched: list[int], folder: str) -> dict:
        """Write tables into a folder; the version that has them."""
        tables = {}
        for table, held in live["tables"].items():
            at = f"{self.root}/data/{folder}/{table}"
            columns = self.spark.createDataFrame([], self.tables[table]).columns
            rows = made[table].select(*columns).withColumn("bucket", self.bucket())
            # Partitions of a bucket each, large ones split where Spark finds them so.
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
            there = [n.removeprefix("bucket=") for n in self.files.names(at) if n.startswith("bucket=")]
            strange = set(map(int, there)) - set(touched)
            if strange:
                raise ValueError(f"{table} has rows of buckets that the keys don't touch: {sorted(strange)}")
            tables[table] = {b: f for b, f in held.items() if int(b) not in touched} | {b: folder for b in there}
        return live | {"version": live["version"] + 1, "tables": tables}

    def _switch(self, new: dict) -> bool:
        """Make a version live, unless there is another of its number."""
        return self.files.appear(f"{self.root}/versions/{new['version']:09d}.json", json.dumps(new))

    def sweep(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions has, and older versions; for times without merges."""
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and not n.startswith(".")]
        kept = [json.loads(self.files.text(f"{self.root}/versions/{n}")) for n in names[-keep:]]
        used = {f for v in kept for held in v["tables"].values() for f in held.values()}
        gone = [f for f in self.files.names(f"{self.root}/data") if f not in used]
        for f in gone:
            self.files.remove(f"{self.root}/data/{f}")
        for n in names[:-keep]:
            self.files.remove(f"{self.root}/versions/{n}")
        return gone
