"""Tables that are merged when they are read: what a writer adds is as large as its change, not as the table.

A table is a folder with a log and data folders. A commit is one log file named by its version, created exclusively, so of two writers that
built on the same version one fails. A change holds the rows it adds or replaces and the keys it removes, dealt to buckets by key; reading takes the last base and
what changed since, per key the latest. `compact` writes that as a new base. A batch id that its writer has committed before is skipped.

The exclusive creation is the file system's: HDFS and object stores with conditional writes decide it themselves; the local file system
(tests) looks first and creates then.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, GONE, BUCKET = "__version", "__gone", "__bucket"


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version first; nothing of this change is visible, and the batch can run again."""


class Commit(NamedTuple):
    version: int
    kind: str  # base or change
    folder: str
    done: dict[str, int]  # last batch of each writer, so far
    schema: str  # of the folder: a change without rows leaves no file to take it from


class ChangeTable:
    """`keys` name a row; `buckets` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._hadoop, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the log

    def version(self) -> int:
        """The newest committed version, 0 for a table without any."""
        log = self._hadoop(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def commit_of(self, version: int) -> Commit:
        file = self._fs.open(self._hadoop(f"{self.path}/log/{version:012d}"))
        try:
            return Commit(**json.loads(self._text.toString(file, "UTF-8")))
        finally:
            file.close()

    def _commits(self, version: int) -> list[Commit]:
        """From the last base on, oldest first."""
        found: list[Commit] = []
        while version and not (found and found[-1].kind == "base"):
            found.append(self.commit_of(version))
            version -= 1
        return found[::-1]

    def _commit(self, commit: Commit) -> None:
        path = self._hadoop(f"{self.path}/log/{commit.version:012d}")
        try:
            file = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                raise ConcurrentWrite(f"version {commit.version} of {self.path} was committed by another writer") from e
            raise
        try:
            file.write(bytearray(json.dumps(commit._asdict()).encode()))
        finally:
            file.close()

    def done(self, writer: str) -> int:
        """The last batch that the writer committed, -1 for none."""
        version = self.version()
        return self.commit_of(version).done.get(writer, -1) if version else -1

    # reading

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The rows as of a version; None before the first commit. `only` (some of the keys) restricts them to those keys."""
        commits = self._commits(self.version() if version is None else version)
        if not commits:
            return None
        parts = [self.spark.read.schema(T.StructType.fromJson(json.loads(c.schema))).parquet(f"{self.path}/{c.folder}").withColumn(VERSION, F.lit(c.version)) for c in commits]
        if only is not None:
            asked = only.distinct()
            # A few buckets out of many: the numbers are bounded by `buckets`, and the scan prunes its folders by them.
            wanted = [r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect()] if set(only.columns) >= {self.keys[0]} else None
            parts = [(p.where(F.col(BUCKET).isin(wanted)) if wanted is not None else p).join(asked, asked.columns, "left_semi") for p in parts]
        base, changes = (parts[0], parts[1:]) if commits[0].kind == "base" else (None, parts)
        latest = None
        for p in changes:
            latest = p if latest is None else latest.unionByName(p, allowMissingColumns=True)
        if latest is None:
            return base.drop(VERSION, GONE, BUCKET)
        rest = [c for c in latest.columns if c not in self.keys]
        latest = latest.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("__row")).select(*self.keys, "__row.*")
        if base is not None:
            same = [base[k].eqNullSafe(F.col(f"hit.{k}")) for k in self.keys]
            latest = base.join(latest.select(*self.keys).alias("hit"), same, "left_anti").unionByName(latest, allowMissingColumns=True)
        return latest.where(~F.col(GONE)).drop(VERSION, GONE, BUCKET)

    def _bucket(self) -> F.Column:
        """By the first key alone, so that rows asked for by it are found in few buckets."""
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    # writing

    def _write(self, rows: DataFrame, kind: str, version: int, done: dict[str, int]) -> None:
        folder = f"{kind}-{version}-{uuid.uuid4().hex[:8]}"
        placed = rows.withColumn(BUCKET, self._bucket())
        # One stretch of buckets a task; a base deals a bucket to as many tasks as AQE finds fit.
        placed = placed.repartition(BUCKET) if kind == "change" else placed.hint("rebalance", BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        self._commit(Commit(version, kind, folder, done, placed.schema.json()))

    def save(self, rows: DataFrame, removed: DataFrame | None = None, read_version: int | None = None, batch_id: int = -1, writer: str = "") -> bool:
        """Add or replace `rows` and take out the keys of `removed`; False if the writer has committed the batch before.

        `read_version` is the version that the change was made from; if another has been committed since, the change fails.
        """
        version = self.version()
        done = self.commit_of(version).done if version else {}
        if 0 <= batch_id <= done.get(writer, -1):
            return False
        if read_version is not None and read_version != version:
            raise ConcurrentWrite(f"{self.path} is at version {version}; the change was made from {read_version}")
        change = rows.withColumn(GONE, F.lit(False))
        if removed is not None:
            change = change.unionByName(removed.select(*self.keys).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        self._write(change, "change", version + 1, done | {writer: batch_id} if batch_id >= 0 else done)
        return True

    def replace(self, old: DataFrame | None, new: DataFrame, **commit) -> bool:
        """Save what differs between the rows `old` and `new` of the same keys: changed and added rows, and keys that are gone."""
        if old is None:
            return self.save(new, **commit)
        same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in new.columns if c in old.columns]
        keyed = [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in self.keys]
        changed = new.alias("new").join(old.alias("old"), same, "left_anti")
        gone = old.alias("old").join(new.alias("new"), keyed, "left_anti").select(*self.keys)
        return self.save(changed, gone, **commit)

    def changes_since_base(self) -> int:
        commits = self._commits(self.version())
        return len(commits) - bool(commits and commits[0].kind == "base")

    def compact(self) -> bool:
        """Write all rows as a new base. It is a commit like any other: a writer that builds on the version before fails and runs again."""
        version = self.version()
        if not version or not self.changes_since_base():
            return False
        rows = self.read(version).withColumn(GONE, F.lit(False))
        self._write(rows, "base", version + 1, self.commit_of(version).done)
        return True
