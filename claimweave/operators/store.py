"""The claim store: tables of immutable bucket folders, and numbered versions that say which folders are current."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.extract import config, java, python, sql
from claimweave.operators.incremental import upsert
from claimweave.schema import CLAIM, conform
from claimweave.tables import settled

#: Folders of a table; a change rewrites those of the owners that it touches.
BUCKETS = 64
#: Versions that stay readable; folders that none of them names are removed.
HISTORY = 3
#: Seconds after which a lock is that of a writer that died, and that a writer waits for another.
EXPIRES, PATIENCE = 3600.0, 0.0
#: Tables besides the claims: what was parsed of each file, and each file's blob or the reason why it couldn't be read.
PARSED = {"python": python.SCHEMA, "java": java.SCHEMA, "config": config.SCHEMA, "sql": sql.SCHEMA}
TABLES = {"claims": CLAIM, "files": "path string, blob string, reason string", **PARSED}


def bucket_of(owner: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(owner, F.lit(""))), F.lit(buckets)).cast("int")


def owner_of(table: str) -> str:
    return "owner_path" if table == "claims" else "path"


class Change:
    """What a writer that holds the lock puts in place of the current version."""

    def __init__(self, store: ClaimStore) -> None:
        self.store, self.before = store, store.version()
        self.after: dict = {t: dict(m) for t, m in self.before["tables"].items()}

    def read(self, table: str) -> DataFrame:
        return self.store.table(table, self.before)

    def now(self, table: str) -> DataFrame:
        """The table with what was written so far."""
        return self.store.table(table, {"tables": self.after})

    def touched(self, table: str, *owners: DataFrame) -> list[int]:
        """Buckets of the owners (column owner); at most BUCKETS numbers."""
        every = owners[0]
        for o in owners[1:]:
            every = every.union(o)
        return sorted(r.b for r in every.select(bucket_of(F.col("owner")).alias("b")).distinct().collect())

    def write(self, table: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """The rows of the buckets, or of all of them, from now on."""
        folder, owner = f"{table}-{uuid.uuid4().hex}", owner_of(table)
        order = ["scope", "claim_id"] if table == "claims" else [owner]
        out = rows.withColumn("bucket", bucket_of(F.col(owner)))
        out = out if buckets is None else out.where(F.col("bucket").isin(buckets))
        out.repartition("bucket", owner).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        made = self.store.children(folder, "bucket=")
        kept = {} if buckets is None else {b: f for b, f in self.after.get(table, {}).items() if int(b) not in set(buckets)}
        self.after[table] = kept | {b.removeprefix("bucket="): f"{folder}/{b}" for b in made}

    def replace(self, table: str, owners: DataFrame, rows: DataFrame) -> None:
        """Rows of the owners (column owner) give way to the new ones; only their buckets are read and written. Stored rows with a new row's
        claim_id give way too, wherever they are."""
        own, stored, rows = owner_of(table), self.read(table), rows.select(*self.store.names(table))
        parts = [owners.select("owner"), rows.select(F.col(own).alias("owner"))]
        if table == "claims":
            parts.append(stored.select(F.col(own).alias("owner"), "claim_id").join(rows.select("claim_id"), "claim_id", "left_semi").select("owner"))
        buckets = self.touched(table, *parts)
        here = stored.where(bucket_of(F.col(own)).isin(buckets)).join(owners.select(F.col("owner").alias(own)).distinct(), own, "left_anti")
        self.write(table, upsert(here, rows) if table == "claims" else here.unionByName(rows), buckets)


class ClaimStore:
    """A version is a file of its own, made whole before it gets its number, so readers see the version before a change or the one after it.
    Writers take the lock before they read, one at a time; the lock of a writer that died expires."""

    def __init__(self, spark: SparkSession, root: str, machine: str = "local") -> None:
        self.spark, self.root, self.machine = spark, root.rstrip("/"), machine
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))

    def _file(self, name: str):
        return self._path(f"{self.root}/{name}")

    def children(self, folder: str, prefix: str = "") -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._file(folder)))
        return sorted(n for n in names if n.startswith(prefix))

    def names(self, table: str) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]

    # --- versions ---

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self.children("_versions") if n.isdigit())

    def version(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {}}
        stream = self._fs.open(self._file(f"_versions/{number or numbers[-1]:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> str | None:
        return str(n) if (n := self.version()["number"]) else None

    def _put(self, name: str, text: str) -> None:
        stream = self._fs.create(self._file(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    @contextmanager
    def change(self, wait: float = PATIENCE) -> Iterator[Change]:
        """The lock, held from before the first read until the new version has its number."""
        lock, until = self._file("LOCK"), time.monotonic() + wait
        while not self._taken(lock):
            if not self._expired(lock):
                if time.monotonic() >= until:
                    raise RuntimeError(f"another writer holds {lock}")
                time.sleep(0.1)
        try:
            change = Change(self)
            yield change
            if change.after != change.before["tables"]:
                number = change.before["number"] + 1
                part = f"_versions/part-{uuid.uuid4().hex}"
                self._put(part, json.dumps({"number": number, "tables": change.after}))
                if not self._fs.rename(self._file(part), self._file(f"_versions/{number:020d}")):
                    raise RuntimeError(f"version {number} couldn't be named")
                self._clean()
        finally:
            self._fs.delete(lock, False)

    def _taken(self, lock) -> bool:
        """Makes the lock file, if nobody else has. File systems of clusters do so at once; that of a machine needs its own call for it."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.createNewFile(lock)
        try:
            os.close(os.open(lock.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False

    def _expired(self, lock) -> bool:
        """Removes a lock that is too old; of several that try, one can rename it."""
        try:
            old = time.time() * 1000 - self._fs.getFileStatus(lock).getModificationTime() > EXPIRES * 1000
        except Exception:  # it is gone by now
            return True
        gone = self._file(f"LOCK-{uuid.uuid4().hex}")
        return bool(old and self._fs.rename(lock, gone) and self._fs.delete(gone, False))

    def _clean(self) -> None:
        numbers = self._numbers()
        for n in numbers[:-HISTORY]:
            self._fs.delete(self._file(f"_versions/{n:020d}"), False)
        named = {f.split("/")[0] for n in numbers[-HISTORY:] for m in self.version(n)["tables"].values() for f in m.values()}
        for folder in self.children(""):
            if folder.rsplit("-", 1)[0] in TABLES and folder not in named:
                self._fs.delete(self._file(folder), True)

    # --- reading ---

    def table(self, name: str, version: dict | None = None) -> DataFrame:
        folders = list((version or self.version())["tables"].get(name, {}).values())
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The current claims. Those of another machine that nobody derived here are marked as unverified."""
        return self._trusted(self.table("claims"))

    def _trusted(self, claims: DataFrame) -> DataFrame:
        return claims.withColumn("trust", F.when(F.col("origin").eqNullSafe(F.lit(self.machine)), F.col("trust")).otherwise("unverified_foreign"))

    def by_path(self, path: str) -> DataFrame:
        return self.read().where(F.exists("bindings", lambda b: b["path"] == path))

    def owned_by(self, path: str) -> DataFrame:
        """The claims that a path owns, from the one folder that holds them."""
        version = self.version()
        b = self.spark.range(1).select(bucket_of(F.lit(path)).alias("b")).first().b
        folders = {k: f for k, f in version["tables"].get("claims", {}).items() if int(k) == b}
        return self._trusted(self.table("claims", {"tables": {"claims": folders}})).where(F.col("owner_path") == path)

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("claim_id").isin(*ids))

    # --- writing ---

    def stamped(self, claims: DataFrame) -> DataFrame:
        """Claims as derived here, unless they say where."""
        return conform(claims).withColumn("origin", F.coalesce("origin", F.lit(self.machine))).withColumn("trust", F.coalesce("trust", F.lit("local")))

    def commit(self, claims: DataFrame, wait: float = PATIENCE) -> str:
        """Replaces all claims."""
        with self.change(wait) as change:
            change.write("claims", self.stamped(claims))
        return self.current()

    def put(self, claims: DataFrame, wait: float = PATIENCE) -> str:
        with self.change(wait) as change:
            change.replace("claims", self.spark.createDataFrame([], "owner string"), self.stamped(claims))
        return self.current()

    def update(self, ids: list[str], work: Callable[[DataFrame], DataFrame], wait: float = PATIENCE) -> str:
        """What work makes of the claims of these ids replaces them; they are read behind the lock."""
        with self.change(wait) as change:
            own = self._trusted(change.read("claims")).where(F.col("claim_id").isin(*ids))
            change.replace("claims", self.spark.createDataFrame([], "owner string"), self.stamped(settled(conform(work(own)))))
        return self.current()

    def delete(self, ids: DataFrame, wait: float = PATIENCE) -> str:
        with self.change(wait) as change:
            stored = change.read("claims")
            buckets = change.touched("claims", stored.select("claim_id", F.col("owner_path").alias("owner")).join(ids.select("claim_id"), "claim_id", "left_semi").select("owner"))
            change.write("claims", stored.where(bucket_of(F.col("owner_path")).isin(buckets)).join(ids.select("claim_id"), "claim_id", "left_anti"), buckets)
        return self.current()

    def replace_paths(self, paths: DataFrame, claims: DataFrame, wait: float = PATIENCE) -> str:
        """Claims that the paths own give way to the new ones; edges and claims of several paths go by the path that owns them."""
        with self.change(wait) as change:
            change.replace("claims", paths.select(F.col("path").alias("owner")), self.stamped(claims))
        return self.current()
