"""Tables under one commit log: keyed merges that are seen whole or not at all, over any number of tables (S6, S7, S13, ST1)."""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stores import latest


class File(NamedTuple):
    """A data file: its path below the ledger, the least key that belongs to it (None: no bound below), its rows, and their bytes as `_size`
    counts them (None in entries of before they were kept)."""

    path: str
    low: int | str | None
    rows: int
    bytes: int | None = None


class State(NamedTuple):
    """What a version of the log says: each table's files in key order, and the last batch of each source."""

    version: int
    tables: dict[str, list[File]]
    done: dict[str, int]

    def plus(self, entry: dict) -> State:
        tables = dict(self.tables)
        for name, change in entry["tables"].items():
            gone = set(change["remove"])
            kept = [f for f in tables.get(name, []) if f.path not in gone] + [File(*f) for f in change["add"]]
            tables[name] = sorted(kept, key=lambda f: (f.low is not None, f.low))
        done = self.done | ({entry["source"]: entry["batch"]} if entry.get("source") is not None else {})
        return State(entry["version"], tables, done)


def _size(schema: T.StructType) -> Column:
    """The bytes of a table's cells before any compression: of texts and nested values their text's, of others 8."""
    fixed = (T.NumericType, T.DatetimeType, T.BooleanType)
    cells = [F.lit(8) if isinstance(f.dataType, fixed) else F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in schema.fields]
    return F.coalesce(F.sum(sum(cells, F.lit(0)).cast("long")), F.lit(0))


class Ledger:
    """Tables as Parquet files with a commit log.

    Folders: data/<a fresh id>/... and log/<version>.json. A writer puts new files under an id of its own and then creates the log
    entry one above the version that it read, by a rename that fails where the entry exists (HDFS and local folders have it; an object store
    needs a committer that does). Whoever comes second takes the entry in: if it changed none of the files that the
    writer replaces, the same files are entered one version later, else the merge is made again. A crash before the rename leaves
    files that no entry names (`vacuum` removes them), one after it a finished commit. Entries may name their source and batch; a
    batch that is not above the source's last one is passed over. A stream's source is an id kept in its checkpoint, so a
    lost checkpoint, whose batches count from 0 again, is another source.

    The files of a table part the range of its key: a file holds the keys from its `low` to below the next one's. A merge reads and
    writes only the files that its keys fall into, cut so that the task that makes a file reads about rows_per_file rows or bytes_per_file
    bytes at most. Every STATE_EACH versions the whole state is written too, so a reader opens at most as many
    entries. The driver holds the list of files; rows stay with the executors.
    """

    STATE_EACH = 16

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 1_000_000, attempts: int = 20, bytes_per_file: int = 64_000_000):
        self.spark, self.path, self.rows_per_file, self.attempts, self.bytes_per_file = spark, path.rstrip("/"), rows_per_file, attempts, bytes_per_file

    # files

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def _texts(self, names: list[str]) -> list[dict]:
        if not names:
            return []
        rows = self.spark.read.text([f"{self.path}/{n}" for n in names], wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["version"])

    def _create(self, name: str, content: dict) -> bool:
        """Whether this writer is the one that created the file."""
        files, path = self._at(name)
        _, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        files.mkdirs(path.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, path, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            files.delete(draft, False)
            return False
        return True

    # the log

    def state(self, version: int | None = None) -> State:
        """The newest state, or an earlier version's."""
        names = self._names("log")
        numbers = lambda kind: [int(n[: -len(kind)]) for n in names if n.endswith(kind)]
        upto = [v for v in numbers(".entry.json") if version is None or v <= version]
        whole = max((v for v in numbers(".state.json") if version is None or v <= version), default=-1)
        now = State(-1, {}, {})
        if whole >= 0:
            held = self._texts([f"log/{whole:020}.state.json"])[0]
            now = State(whole, {k: [File(*f) for f in v] for k, v in held["tables"].items()}, held["done"])
        for entry in self._texts([f"log/{v:020}.entry.json" for v in upto if v > whole]):
            now = now.plus(entry)
        return now

    def _commit(self, entry: dict, state: State) -> bool:
        if not self._create(f"log/{entry['version']:020}.entry.json", entry):
            return False
        if entry["version"] % self.STATE_EACH == self.STATE_EACH - 1:
            after = state.plus(entry)
            self._create(f"log/{after.version:020}.state.json", {"version": after.version, "tables": after.tables, "done": after.done})
        return True

    def source_of(self, checkpoint: str) -> str:
        """The id kept in a stream's checkpoint folder, made at its first use."""
        there = Ledger(self.spark, checkpoint)
        there._create("writer.json", {"version": 0, "id": uuid.uuid4().hex})
        return there._texts(["writer.json"])[0]["id"]

    # rows

    def _frame(self, files: list[File], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f.path}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def read(self, table: str, schema: T.StructType, least=None, largest=None, version: int | None = None) -> DataFrame:
        """A table's rows; with bounds of the key, only files that may hold keys between them are opened (their other keys too)."""
        files = self.state(version).tables.get(table, [])
        lows = [f.low for f in files[1:]]
        first = bisect.bisect_right(lows, least) if least is not None else 0
        last = bisect.bisect_right(lows, largest) if largest is not None else len(files)
        return self._frame(files[first : last + 1], schema)

    def _slot(self, files: list[File], key: str) -> Column:
        """The number of the file that a key belongs to."""
        lows = [f.low for f in files[1:]]
        if not lows:
            return F.lit(0)
        bounds = np.array(lows, np.int64 if isinstance(lows[0], int) else object)

        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, keys.to_numpy(bounds.dtype), side="right").astype(np.int32))

        return place(F.col(key))

    def _merged(self, files: list[File], batch: DataFrame, key: str) -> dict:
        """Writes the files that a staged batch of distinct keys falls into anew; the log's change."""
        slot = self._slot(files, key)
        touched = sorted(r["s"] for r in batch.select(slot.alias("s")).distinct().collect())  # at most one a file
        old = [files[s] for s in touched if s < len(files)]
        kept = self._frame(old, batch.schema).join(batch.select(key), key, "left_anti").select(*batch.columns)
        size, total = _size(batch.schema), F.count("*").alias("rows")
        new = batch.agg(total, size.alias("bytes")).first()
        held = sum(f.bytes for f in old) if all(f.bytes is not None for f in old) else self._frame(old, batch.schema).agg(size).first()[0]
        parts = max(1, -(-(sum(f.rows for f in old) + new["rows"]) // self.rows_per_file), -(-(held + new["bytes"]) // self.bytes_per_file))
        folder = f"data/{uuid.uuid4().hex}"
        rows = kept.unionByName(batch).withColumn("_slot", slot)
        rows.repartitionByRange(parts, "_slot", key).sortWithinPartitions("_slot", key).write.partitionBy("_slot").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("_slot", T.IntegerType())])).parquet(f"{self.path}/{folder}")
        found = written.groupBy("_slot", F.col("_metadata.file_path").alias("p")).agg(F.min(key).alias("low"), total, size.alias("bytes")).orderBy("_slot", "low").collect()
        add, last = [], None
        for r in found:
            first = r["_slot"] != last
            last = r["_slot"]
            low = (files[last].low if files else None) if first else r["low"]
            add.append(File(folder + r["p"].split(folder, 1)[1], low, r["rows"], r["bytes"]))
        return {"remove": [f.path for f in old], "add": add}

    def upsert(self, batches: dict[str, tuple[DataFrame, str, str]], source: str | None = None, batch: int | None = None, before_commit: Callable = lambda: None) -> int | None:
        """Merges each table's rows, given as (rows, key, order): of rows of one key in the batch the last by order, in place of the table's
        row of that key. One log entry for all tables. Returns its version, or None where the source's batch had been entered or nothing
        was given. Keys are long or string, without nulls. before_commit is called between the data and the log."""
        state = self.state()
        if source is not None and state.done.get(source, -1) >= batch:
            return None
        staged = {}
        for name, (rows, key, order) in batches.items():
            held = f"{self.path}/data/{uuid.uuid4().hex}"
            latest(rows, key, order).write.parquet(held)
            staged[name] = (self.spark.read.schema(rows.schema).parquet(held), key)
        made: dict[str, dict] = {}
        for _ in range(self.attempts):
            for name, (rows, key) in staged.items():
                files = state.tables.get(name, [])
                still = name in made and set(made[name]["remove"]) <= {f.path for f in files} and (made[name]["remove"] or not files)
                if not still:
                    made[name] = self._merged(files, rows, key)
            entry = {"version": state.version + 1, "source": source, "batch": batch, "tables": {n: c for n, c in made.items() if c["add"]}}
            before_commit()
            if self._commit(entry, state):
                return entry["version"]
            state = self.state()
            if source is not None and state.done.get(source, -1) >= batch:
                return None
        raise RuntimeError(f"{self.attempts} other commits came first")

    def ensure(self, table: str, recreate: bool = False) -> None:
        """A table without rows if there is none; recreate takes all its files out, as one commit."""
        for _ in range(self.attempts):
            state = self.state()
            files = state.tables.get(table)
            if files is not None and not (recreate and files):
                return
            change = {"remove": [f.path for f in files or []], "add": []}
            if self._commit({"version": state.version + 1, "source": None, "batch": None, "tables": {table: change}}, state):
                return
        raise RuntimeError(f"{self.attempts} other commits came first")

    def vacuum(self, older_than_seconds: float = 7 * 86_400) -> int:
        """Removes data folders that the newest state does not name and that were last changed so long ago, so that readers and writers under
        way keep theirs. Returns how many."""
        named = {f.path.split("/")[1] for files in self.state().tables.values() for f in files}
        files, folder = self._at("data")
        gone = 0
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for f in files.listStatus(folder) if files.exists(folder) else []:
            if f.getPath().getName() not in named and now - f.getModificationTime() >= older_than_seconds * 1000:
                files.delete(f.getPath(), True)
                gone += 1
        return gone
