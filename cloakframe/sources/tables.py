"""SRC-4, SRC-5, SNK-1, SNK-2, S-1, S-2: the token vault and the blind index as Parquet tables.

A table is a folder of immutable Parquet segments plus numbered snapshot files that list the
live ones. Appending or deleting writes a new segment and then creates the next snapshot file;
creating it fails when somebody else was first, so two writers cannot both win. Deletes are
segments of keys that readers anti-join, which keeps a delete proportional to what it removes.

Rows are partitioned by ``kid`` and by a ``shard`` taken from the leading characters of the
(uniformly random) key, so one kid holding most rows still spreads over all shards, and a small
probe prunes to the shards it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import predicates as P
from cloakframe.functions.text import first_error
from cloakframe.plans.runtime import cut_lineage

KID_HASH = "BLAKE2b(256)"
INDEX_DIGEST_MAX_CHARS = 128


class TableError(ValueError):
    """A table broke its contract or a write was refused."""


class ConcurrentWrite(TableError):
    """Another writer created the next snapshot first."""


class SnapshotTable:
    """A keyed set of rows: ``kid``, one key column, and optional payload columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, payload: list[str]) -> None:
        self.spark, self.path, self.key, self.payload = spark, path.rstrip("/"), key, payload
        jvm = spark._jvm
        self._path_of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path_of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- snapshots --------------------------------------------------------------------

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, key: str, payload: list[str], shard_chars: int = 1
    ) -> SnapshotTable:
        """``shard_chars`` hex characters give 16**n shards; 1 for tests, 2 or 3 for terabytes."""
        table = cls(spark, path, key, payload)
        state = {
            "segments": [],
            "deletes": [],
            "shard_chars": shard_chars,
            "columns": ["kid", key, *payload],
        }
        table._commit(state, 0)
        return table

    def _version_file(self, version: int):
        return self._path_of(f"{self.path}/_versions/{version:08d}.json")

    def version(self) -> int:
        folder = self._path_of(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            raise TableError(f"no table at {self.path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        stream = self._fs.open(self._version_file(self.version() if version is None else version))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        state = json.loads(text)
        if state["columns"] != ["kid", self.key, *self.payload]:
            raise TableError(f"table columns are {state['columns']}")
        return state

    def _commit(self, state: dict, version: int) -> int:
        """Write the snapshot under another name, then rename it into place.

        A reader sees a whole snapshot or none. The rename refuses to replace a file, which
        decides between two writers; every other failure is raised as it is.
        """
        jvm = self.spark._jvm
        target = self._version_file(version)
        staged = self._path_of(f"{self.path}/_versions/_{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(target):
            self._fs.delete(staged, False)
            raise ConcurrentWrite(f"snapshot {version} exists already")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 0)
        try:
            context.rename(staged, target, how)
        except Exception as err:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" not in str(err):
                raise
            raise ConcurrentWrite(f"snapshot {version} exists already") from err
        return version

    # --- reading ----------------------------------------------------------------------

    def shard(self, key: Column, state: dict) -> Column:
        return F.lower(F.left(key, F.lit(state["shard_chars"])))

    def _load(self, kind: str, ids: list[str], columns: list[str]) -> DataFrame:
        names = [*columns, "segment", "kid", "shard"]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if not ids:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{kind}"
        paths = [f"{base}/segment={i}" for i in ids]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def read(self, version: int | None = None, shards: list[str] | None = None) -> DataFrame:
        """Live rows: ``kid, shard, <key>, <payload>``. Pinned to a snapshot for its lifetime.

        ``shards`` limits data and deletes to the folders of these shards.
        """
        state = self.state(version)
        columns = ["kid", "shard", self.key]
        here = F.lit(True) if shards is None else F.col("shard").isin(shards)
        rows = self._load("data", state["segments"], [self.key, *self.payload])
        rows = rows.filter(here).select(*columns, *self.payload)
        if state["deletes"]:
            gone = self._load("gone", state["deletes"], [self.key]).filter(here).select(*columns)
            rows = rows.join(gone, columns, "left_anti")
        return rows

    def shards_of(self, probe: DataFrame) -> list[str]:
        """The distinct shards of a frame with a ``shard`` column; at most 16**shard_chars."""
        found = probe.select("shard").distinct().where("shard is not null").collect()
        return sorted(r.shard for r in found)

    # --- writing ----------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, columns: list[str], state: dict) -> str:
        """Write one segment. The rebalance hint lets AQE split a hot shard over writers."""
        segment = uuid.uuid4().hex
        out = df.select(
            F.col("kid"), self.shard(F.col(self.key), state).alias("shard"), *columns
        )
        out = out.hint("rebalance", F.col("kid"), F.col("shard"))
        (
            out.sortWithinPartitions("kid", "shard", self.key)
            .write.partitionBy("kid", "shard")
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .parquet(f"{self.path}/{kind}/segment={segment}")
        )
        return segment

    def stage(self, df: DataFrame) -> str:
        """Write rows nobody can see yet; ``publish`` makes them visible."""
        return self._write(df, "data", [self.key, *self.payload], self.state())

    def staged(self, segment: str) -> DataFrame:
        rows = self._load("data", [segment], [self.key, *self.payload])
        return rows.select("kid", "shard", self.key, *self.payload)

    def publish(self, segment: str, version: int) -> int:
        state = self.state(version)
        state["segments"].append(segment)
        return self._commit(state, version + 1)

    def delete(self, keys: DataFrame, version: int, mark: tuple[str, int] | None = None) -> int:
        """Remove ``(kid, key)`` rows from the snapshot ``version``.

        ``mark`` records in the same commit how far a named stream has come.
        """
        state = self.state(version)
        state["deletes"].append(self._write(keys, "gone", [self.key], state))
        if mark is not None:
            state.setdefault("marks", {})[mark[0]] = mark[1]
        return self._commit(state, version + 1)

    def compact(self) -> int:
        """Rewrite the live rows as one segment without pending deletes."""
        version = self.version()
        state = self.state(version)
        live = self.read(version)
        segment = self._write(live, "data", [self.key, *self.payload], state)
        return self._commit({**state, "segments": [segment], "deletes": []}, version + 1)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete segments and snapshots that none of the newest ``keep_versions`` uses.

        Only then are redeemed rows gone from disk (after ``compact``). Run it when no writer is
        staging and no reader uses an older snapshot. Returns the number of segments deleted.
        """
        if keep_versions < 1:
            raise ValueError("keep_versions must be at least 1")
        newest = self.version()
        kept = range(max(newest - keep_versions + 1, 0), newest + 1)
        states = [self.state(v) for v in kept if self._fs.exists(self._version_file(v))]
        gone = 0
        for kind, field in (("data", "segments"), ("gone", "deletes")):
            used = {f"segment={i}" for s in states for i in s[field]}
            folder = self._path_of(f"{self.path}/{kind}")
            found = list(self._fs.listStatus(folder)) if self._fs.exists(folder) else []
            for status in found:
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        for v in range(kept.start):
            self._fs.delete(self._version_file(v), False)
        return gone

    def has(self, path: str) -> bool:
        return self._fs.exists(self._path_of(path))

    def erase(self, path: str) -> None:
        """Remove a folder below the table that no snapshot lists."""
        if not path.startswith(f"{self.path}/_"):
            raise TableError("only folders beside the segments can be erased")
        self._fs.delete(self._path_of(path), True)

    def matching(self, probe: DataFrame, version: int | None = None) -> DataFrame:
        """Stored keys that occur in ``probe``; only the probe's shards are read."""
        version = self.version() if version is None else version
        state = self.state(version)
        wanted = probe.select(
            "kid", self.shard(F.col(self.key), state).alias("shard"), self.key
        )
        stored = self.read(version, self.shards_of(wanted)).select("kid", "shard", self.key)
        return stored.join(wanted, ["kid", "shard", self.key], "left_semi")


# --- token vault ----------------------------------------------------------------------


def create_vault(spark: SparkSession, path: str, shard_chars: int = 1) -> SnapshotTable:
    return SnapshotTable.create(spark, path, "hashid", ["data"], shard_chars)


def open_vault(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, "hashid", ["data"])


def vault_row_error() -> Column:
    return first_error(
        P.hash_hex_error("tokens.kid", "kid", KID_HASH),
        P.hash_hex_error("tokens.hashid", "hashid", "SHA-256"),
        P.envelope_error("tokens.data", "data"),
    )


def scan_vault(
    spark: SparkSession, path: str, kids: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """SRC-4: ``(rows, bad)``; ``kids`` prunes partitions before anything is read."""
    rows = open_vault(spark, path).read()
    if kids is not None:
        rows = rows.filter(F.col("kid").isin(*kids))
    checked = rows.withColumn("error", vault_row_error())
    good = checked.filter(F.col("error").isNull()).drop("error")
    return good, checked.filter(F.col("error").isNotNull())


def read_vault_export(
    spark: SparkSession,
    url: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    table: str = "tokens",
    **options: str,
) -> DataFrame:
    """Read a vault kept in a relational database (needs its JDBC driver on the class path).

    The read is cut by a numeric ``column`` with values from ``lower`` to ``upper``.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, **options)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def append_vault(tokens: DataFrame, table: SnapshotTable) -> int:
    """SNK-1: add rows; one repeated ``(kid, hashid)`` refuses the whole batch.

    Rows are computed once, into a segment that stays invisible until every check passed.
    """
    version = table.version()
    segment = table.stage(tokens)
    fresh = table.staged(segment)
    bad = fresh.withColumn("error", vault_row_error()).filter("error is not null").first()
    if bad is not None:
        raise TableError(bad["error"]["message"])
    repeated = fresh.groupBy("kid", "hashid").count().filter("count > 1")
    if repeated.first() is not None or table.matching(fresh, version).first() is not None:
        raise TableError("token already exists")
    return table.publish(segment, version)


def consume(table: SnapshotTable, hashids: DataFrame, version: int | None = None) -> int:
    """S-2: delete ``(kid, hashid)`` rows, all or nothing."""
    version = table.version() if version is None else version
    wanted = hashids.select("kid", "hashid").distinct()
    found = table.matching(wanted, version)
    missing = wanted.join(found.select("kid", "hashid"), ["kid", "hashid"], "left_anti")
    if missing.first() is not None:
        raise TableError("token not found")
    return table.delete(wanted, version)


def first_missing(requested: DataFrame, found: DataFrame, key: str = "hashid") -> DataFrame:
    """L-3: the smallest requested key that was not found, as one row."""
    return requested.join(found, key, "left_anti").agg(F.min(key).alias(key))


# --- blind index ----------------------------------------------------------------------


def create_index(spark: SparkSession, path: str, shard_chars: int = 1) -> SnapshotTable:
    return SnapshotTable.create(spark, path, "digest", [], shard_chars)


def open_index(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, "digest", [])


def index_row_error() -> Column:
    return first_error(
        P.hash_hex_error("indexes.kid", "kid", KID_HASH),
        P.hex_error("indexes.digest", "digest"),
        P.bounded_text_error("indexes.digest", "digest", INDEX_DIGEST_MAX_CHARS),
    )


def upsert_index(digests: DataFrame, table: SnapshotTable) -> int:
    """SNK-2: idempotent insert of ``(kid, digest)`` rows.

    ``distinct`` combines inside each task first, so a hot digest is one row per task. Its
    result is stored, because it is compared with the table twice: the stored keys it hits are
    found first (a small batch then costs no shuffle of the table), and the rest is added.
    """
    version = table.version()
    wanted = digests.select("kid", F.lower("digest").alias("digest")).distinct()
    wanted = cut_lineage(wanted)
    present = table.matching(wanted, version).select("kid", "digest")
    fresh = wanted.join(present, ["kid", "digest"], "left_anti")
    segment = table.stage(fresh)
    rows = table.staged(segment)
    bad = rows.withColumn("error", index_row_error()).filter("error is not null").first()
    if bad is not None:
        raise TableError(bad["error"]["message"])
    if rows.first() is None:
        return version
    return table.publish(segment, version)


def index_union(index: DataFrame, new: DataFrame) -> DataFrame:
    """S-1: set union, duplicates ignored."""
    cols = ["kid", "digest"]
    return index.select(*cols).union(new.select(*cols)).distinct()


# --- key registry ---------------------------------------------------------------------

KEYS_SCHEMA = (
    "kid string, properties struct<version:int,profile:string,tag:string,created_at:string,"
    "lifecycle:struct<status:string,reason:string,changed_at:string>>"
)


def scan_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-5: ``(keys ordered by kid, skipped rows)``; a row that cannot be used is not fatal."""
    from cloakframe.operators.access import key_row_error

    rows = spark.read.schema(KEYS_SCHEMA).parquet(path)
    checked = rows.withColumn("error", key_row_error())
    good = checked.filter(F.col("error").isNull()).drop("error").orderBy("kid")
    return good, checked.filter(F.col("error").isNotNull())
