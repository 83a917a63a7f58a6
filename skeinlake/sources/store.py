"""Operation log, snapshots and current state (M1-M18, SC12-SC20, A1, A11, J12).

The log is append-only parquet, a folder a commit: lsn, op, id, vec,
attributes, payload, has_vec and has_meta.  The current state folds the last
vector and the last attributes of each id that was not deleted; a snapshot is
that state at an lsn, and recovery folds the snapshot with the log's tail.

* One writer at a time: a commit claims its first lsn by creating a file that
  must not exist, so a second writer fails instead of using an lsn twice.
* A commit counts once its folder is complete.  On opening, a last commit that
  was cut short is dropped; one before it, or a gap, is corruption and raises.
* Manifests are numbered, and the newest that can be read counts: there is no
  moment without one.  A checkpoint writes the state, then the manifest, then
  removes the commits that the state covers and what older manifests name.
"""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import Config

OPS = ("insert", "update", "set_meta", "delete", "checkpoint")


def log_schema(config: Config) -> T.StructType:
    return T.StructType([
        T.StructField("lsn", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())),
        *config.schema.struct().fields, T.StructField("payload", T.BinaryType()), T.StructField("has_vec", T.BooleanType()), T.StructField("has_meta", T.BooleanType()),
    ])


def fold(log: DataFrame, attrs: list[str]) -> DataFrame:
    """(id, vec, attributes, payload, lsn): the live rows of a log in any order.

    An update may carry its attributes forward (``has_meta`` false); the last
    row that has them counts, explicit nulls included.  Ids are never used
    again, so any delete ends one.  One shuffle by id, combined on the map side.
    """
    meta = F.struct(*[F.col(a) for a in attrs], F.col("payload"))
    state = log.where("op <> 'checkpoint'").groupBy("id").agg(
        F.max_by("vec", F.when(F.col("has_vec"), F.col("lsn"))).alias("vec"),
        F.max_by(meta, F.when(F.col("has_meta"), F.col("lsn"))).alias("m"),
        F.max(F.col("op") == "delete").alias("gone"),
        F.max(F.col("op") == "insert").alias("born"),
        F.max("lsn").alias("lsn"),
    )
    return state.where("born and not gone").select("id", "vec", *[F.col(f"m.{a}").alias(a) for a in attrs], F.col("m.payload").alias("payload"), "lsn")


def counts(log: DataFrame) -> DataFrame:
    """(live, tombstones, next_id): deletes and updates leave a tombstone each."""
    return log.agg(
        (F.count_distinct(F.when(F.col("op") == "insert", F.col("id"))) - F.count_distinct(F.when(F.col("op") == "delete", F.col("id")))).alias("live"),
        F.count(F.when(F.col("op").isin("delete", "update"), 1)).alias("tombstones"),
        (F.coalesce(F.max(F.when(F.col("op") == "insert", F.col("id"))), F.lit(-1)) + 1).alias("next_id"),
    )


def attr_counts(rows: DataFrame, attr: str) -> DataFrame:
    """Live rows a value; null is not counted."""
    return rows.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def attr_counts_after(counted: DataFrame, before: DataFrame, tail: DataFrame, attrs: list[str], attr: str) -> DataFrame:
    """``attr_counts`` of the state ``before`` brought up to date with the
    operations of ``tail`` (A2): rows that these touch leave their old value
    and enter their new one; no other row is read again."""
    touched = tail.where("op <> 'checkpoint'").select("id").distinct()
    old = before.join(touched, "id", "left_semi")
    new = fold(as_log(old, attrs).unionByName(tail), attrs)
    moved = [rows.where(F.col(attr).isNotNull()).select(F.col(attr).alias("value"), F.lit(n).cast("long").alias("n")) for rows, n in ((old, -1), (new, 1))]
    every = counted.unionByName(moved[0]).unionByName(moved[1])
    return every.groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0")


class Store:
    """A keyed table on a folder that Spark reaches.

    ``checkpoint_every`` operations after the last snapshot the next is taken
    by itself; without, only on demand.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config, checkpoint_every: int | None = None) -> None:
        self.spark, self.path, self.config, self.every = spark, path.rstrip("/"), config, checkpoint_every
        self.attrs = [a.name for a in config.schema.attrs]
        self._to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._to(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.reserved: set[int] = set()
        self.manifest = self._load()
        self.commits = self._recover()
        self.lsn = max([c["last"] for c in self.commits] + [self.manifest["lsn"]])
        self.next_id = max([c["next_id"] for c in self.commits] + [self.manifest["next_id"]])

    # -- files --------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        where = self._to(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._to(f"{self.path}/{name}"))

    def _remove(self, name: str) -> None:
        self._fs.delete(self._to(f"{self.path}/{name}"), True)

    def _create(self, name: str, facts: dict[str, Any]) -> None:
        """Exclusive: a file by that name is another writer's."""
        try:
            out = self._fs.create(self._to(f"{self.path}/{name}"), False)
        except Py4JJavaError as error:
            raise RuntimeError(f"{self.path}: {name} is taken by another writer") from error
        out.write(json.dumps(facts).encode())
        out.close()

    def _facts_in(self, name: str) -> dict[str, Any] | None:
        try:
            return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()))
        except ValueError:  # cut short
            return None

    # -- manifest and recovery ----------------------------------------------

    def _facts(self) -> dict[str, Any]:
        c = self.config
        return {"dim": c.dim, "metric": c.metric, "kind": c.kind, "fingerprint": c.schema.fingerprint()}

    def _load(self) -> dict[str, Any]:
        for name in reversed(self._names("manifests")):
            found = self._facts_in(f"manifests/{name}")
            if found is None:
                continue
            for k, v in self._facts().items():
                if found[k] != v:
                    raise ValueError(f"the table has {k} {found[k]!r}, not {v!r}")
            return found
        return {**self._facts(), "number": 0, "snapshot": None, "lsn": 0, "next_id": 0, "tombstones": 0}

    def _recover(self) -> list[dict[str, Any]]:
        """The complete commits after the snapshot, in order."""
        claims, found, at = self._names("claims"), [], None
        for i, name in enumerate(claims):
            first = int(name.removesuffix(".json"))
            facts = self._facts_in(f"claims/{name}")
            whole = facts is not None and self._exists(f"log/{first:020d}/_SUCCESS")
            if not whole and i + 1 < len(claims):
                raise RuntimeError(f"{self.path}: the commit at {first} is damaged, and others follow it")
            if not whole:  # its writer never heard that it counts
                self._remove(f"log/{first:020d}")
                self._remove(f"claims/{name}")
                break
            if first > (at if at is not None else self.manifest["lsn"]) + 1:
                raise RuntimeError(f"{self.path}: commits before {first} are missing")
            at = facts["last"]
            found.append({"first": first, **facts})
        return [c for c in found if c["last"] > self.manifest["lsn"]]

    def verify(self) -> None:
        """Read the whole tail: every commit must hold its operations, once each."""
        want = {c["first"]: c["last"] - c["first"] + 1 for c in self.commits}
        for first, n in want.items():
            rows = self.spark.read.schema(log_schema(self.config)).parquet(f"{self.path}/log/{first:020d}")
            got = rows.agg(F.count_distinct("lsn"), F.count(F.lit(1)), F.min("lsn"), F.max("lsn")).first()
            if tuple(got) != (n, n, first, first + n - 1):
                raise RuntimeError(f"{self.path}: the commit at {first} holds other operations than it should")

    def _save(self, manifest: dict[str, Any]) -> None:
        """The new manifest stands beside the old one until it is complete."""
        manifest = {**manifest, "number": self.manifest["number"] + 1}
        self._create(f"manifests/{manifest['number']:020d}.json", manifest)
        self.manifest = manifest

    def _tidy(self) -> None:
        """Remove commits that the snapshot covers, and what only older manifests name."""
        for c in [c for c in self._names("claims") if int(c.removesuffix(".json")) <= self.manifest["lsn"]]:
            self._remove(f"claims/{c}")  # first: a commit without a claim is not looked for
            self._remove(f"log/{int(c.removesuffix('.json')):020d}")
        for name in self._names("manifests")[:-2]:
            self._remove(f"manifests/{name}")
        named = {(self._facts_in(f"manifests/{m}") or {}).get("snapshot") for m in self._names("manifests")}
        for name in self._names("snapshots"):
            if f"snapshots/{name}" not in named:
                self._remove(f"snapshots/{name}")
        self.commits = [c for c in self.commits if c["last"] > self.manifest["lsn"]]

    # -- writing ------------------------------------------------------------

    def _commit(self, rows: DataFrame, n: int, next_id: int) -> None:
        """``rows`` have the n lsn after the present one."""
        first, facts = self.lsn + 1, {"last": self.lsn + n, "next_id": next_id}
        self._create(f"claims/{first:020d}.json", facts)
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{first:020d}")
        self.commits.append({"first": first, **facts})
        self.lsn, self.next_id = self.lsn + n, next_id
        if self.every and self.lsn - self.manifest["lsn"] >= self.every:
            self.checkpoint()

    def reserve_ids(self, n: int) -> range:
        """Ids for inserts that will name them; no other insert gets these."""
        self.next_id += n
        taken = range(self.next_id - n, self.next_id)
        self.reserved.update(taken)
        return taken

    def append(self, ops: list[dict[str, Any]]) -> list[int | bool]:
        """Validate and log operations as one commit; ids of inserts, else whether
        the id was live.  A bad operation raises before anything is written.  An
        insert may name an id that was reserved and not used yet."""
        touched = {o["id"] for o in ops if "id" in o}
        live = {r[0] for r in self.current().where(F.col("id").isin(sorted(touched))).select("id").collect()} if touched else set()
        rows, results, next_id, lsn = [], [], self.next_id, self.lsn
        for o in ops:
            if o["op"] not in OPS[:4]:
                raise ValueError(f"no operation {o['op']!r}")
            vec = self.config.check(o["vec"]) if o["op"] in ("insert", "update") else None
            has_meta = o["op"] in ("insert", "set_meta") or "attrs" in o
            values = self.config.schema.validate(o.get("attrs"))
            if o["op"] == "insert":
                row_id = o.get("id", next_id)
                if "id" in o and (row_id not in self.reserved or row_id in live):
                    raise ValueError(f"id {row_id} is in use or was not reserved")
                next_id = max(next_id, row_id + 1)
                live.add(row_id)
                results.append(row_id)
            else:
                row_id = o["id"]
                results.append(row_id in live)
                if row_id not in live:
                    continue
                if o["op"] == "delete":
                    live.discard(row_id)
            lsn += 1
            rows.append((lsn, o["op"], row_id, vec, *values, o.get("payload"), vec is not None, has_meta))
        if rows:
            self._commit(self.spark.createDataFrame(rows, log_schema(self.config)).coalesce(1), len(rows), next_id)
        self.reserved -= {o["id"] for o in ops if o["op"] == "insert" and "id" in o}
        return results

    def insert(self, vec: list[float], attrs: list[Any] | None = None, payload: bytes | None = None) -> int:
        return self.append([{"op": "insert", "vec": vec, "attrs": attrs, "payload": payload}])[0]

    def update(self, row_id: int, vec: list[float], **meta: Any) -> bool:
        return self.append([{"op": "update", "id": row_id, "vec": vec, **meta}])[0]

    def set_meta(self, row_id: int, attrs: list[Any], payload: bytes | None = None) -> bool:
        return self.append([{"op": "set_meta", "id": row_id, "attrs": attrs, "payload": payload}])[0]

    def remove(self, row_id: int) -> bool:
        return self.append([{"op": "delete", "id": row_id}])[0]

    def insert_rows(self, rows: DataFrame) -> None:
        """Bulk insert of (vec, attributes, payload) with ids in a row, as one commit.

        Numbers are dealt in two levels (rows a partition, then places in it),
        so no task sees all rows.
        """
        marked = rows.withColumn("_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id())
        marked.write.mode("overwrite").parquet(f"{self.path}/incoming")
        marked = self.spark.read.parquet(f"{self.path}/incoming")
        sizes = marked.groupBy("_p").count()
        before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
        numbered = marked.withColumn("_n", place).join(sizes, "_p").withColumn("_n", F.col("_n") + F.col("_base"))
        n = marked.count()
        log = numbered.select(
            (F.lit(self.lsn + 1) + F.col("_n")).cast("long").alias("lsn"), F.lit("insert").alias("op"), (F.lit(self.next_id) + F.col("_n")).cast("long").alias("id"), "vec",
            *self.attrs, "payload", F.lit(True).alias("has_vec"), F.lit(True).alias("has_meta"),
        )
        if n:
            self._commit(log, n, self.next_id + n)
        self._remove("incoming")

    # -- reading ------------------------------------------------------------

    def log(self) -> DataFrame:
        """The operations after the snapshot: its commits' folders and no others."""
        paths = [f"{self.path}/log/{c['first']:020d}" for c in self.commits]
        if not paths:
            return self.spark.createDataFrame([], log_schema(self.config))
        return self.spark.read.schema(log_schema(self.config)).parquet(*paths).where(F.col("lsn") > self.manifest["lsn"])

    def current(self) -> DataFrame:
        """The live rows: the snapshot and the log after it."""
        tail = self.log()
        if self.manifest["snapshot"]:
            tail = tail.unionByName(as_log(self.spark.read.parquet(f"{self.path}/{self.manifest['snapshot']}"), self.attrs))
        return fold(tail, self.attrs)

    def describe(self) -> dict[str, Any]:
        """Shape and schema: what a reader may rely on, and the last durable lsn."""
        attrs = {a.name: a.type for a in self.config.schema.attrs}
        return {**self._facts(), "attrs": attrs, "attr_count": len(attrs), "rows": self.current().count(), "next_id": self.next_id, "durable_lsn": self.lsn}

    def get(self, row_id: int) -> Any:
        return self.current().where(F.col("id") == row_id).first()

    def contains(self, row_id: int) -> bool:
        return not self.current().where(F.col("id") == row_id).isEmpty()

    def tombstones(self) -> int:
        return self.manifest["tombstones"] + self.log().where(F.col("op").isin("delete", "update")).count()

    # -- maintenance --------------------------------------------------------

    def checkpoint(self, keep_tombstones: bool = True) -> str:
        """Write the state at the present lsn, name it in the manifest, cut the log."""
        return self._snapshot(self.current(), self.tombstones() if keep_tombstones else 0)

    def _snapshot(self, rows: DataFrame, tombstones: int) -> str:
        name = f"snapshots/{self.lsn:020d}-{self.manifest['number'] + 1}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._save({**self._facts(), "snapshot": name, "lsn": self.lsn, "next_id": self.next_id, "tombstones": tombstones})
        self._tidy()
        return name

    def compact(self) -> str:
        """The same with the tombstones forgotten; ids stay as they are."""
        return self.checkpoint(keep_tombstones=False)

    def clear(self) -> str:
        """Forget all rows; schema and ids go on."""
        return self._snapshot(self.current().where("false"), 0)


def as_log(rows: DataFrame, attrs: list[str]) -> DataFrame:
    """State rows as inserts, to be folded with later operations."""
    return rows.select("lsn", F.lit("insert").alias("op"), "id", "vec", *attrs, "payload", F.lit(True).alias("has_vec"), F.lit(True).alias("has_meta"))
