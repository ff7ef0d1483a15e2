"""Tables that change by batches: incremental upsert and repeatable append (§2 A6, A7).

A versioned table is cut into parts by a column of the caller's choice - a range of
the key, so that a batch of neighbouring keys touches few parts.  Under its folder

* ``data/b=<batch>/part=<part>/`` holds the rows of the parts a batch rewrote;
* ``parts/b=<batch>/`` lists, after that batch, the batch that wrote each part.

A batch reads only the parts that its rows fall in, writes them anew below its own
number and then a new list.  Nothing is changed in place: a job that dies leaves
the last list and its files as they were, and the same batch run again writes the
same folders again.  Readers follow the newest list.  The driver holds one number
per part.  ``forget`` removes what no kept list names.

A batch whose few rows fall in most parts is laid over the table instead
(``overlay``): only its rows are written, to ``over/b=<batch>/``, and readers put
them in the place of the rows with their keys.  Every ``FOLD_EVERY`` such batches,
and with any ``upsert``, what was laid over goes into the parts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escrowlens.plans.joins import without_keys
from escrowlens.session import scratch_path

PARTS_SCHEMA = "part long, at long"
FOLD_EVERY = 20


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def batches_in(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``b=<n>`` folders under ``path``, in order."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return []
    jvm = spark.sparkContext._jvm
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if re.fullmatch(r"b=\d+", n) and done(n))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append the rows of one batch; the same batch again replaces its own rows."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/b={batch_id}")


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows appended so far (none yet: no rows)."""
    folders = [f"{path}/b={b}" for b in batches_in(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class VersionedTable:
    """A table below ``base`` whose rows have a key and a ``part`` (a bigint)."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: list[str], part: Column):
        self.spark, self.base, self.schema, self.key, self.part = spark, base, schema, key, part

    @classmethod
    def create(cls, rows: DataFrame, name: str, key: list[str], part: Column) -> VersionedTable:
        """A new table in the shared folder; its first rows are batch 0."""
        spark = rows.sparkSession
        table = cls(spark, scratch_path(spark, f"table-{name}"), rows.schema, key, part)
        table._write(rows, {}, 0)
        return table

    def _parts(self, before: int | None = None) -> dict[int, int]:
        known = [b for b in batches_in(self.spark, f"{self.base}/parts") if before is None or b < before]
        if not known:
            return {}
        rows = self.spark.read.schema(PARTS_SCHEMA).parquet(f"{self.base}/parts/b={known[-1]}").collect()
        return {r["part"]: r["at"] for r in rows}

    def _write(self, rows: DataFrame, parts: dict[int, int], batch_id: int, touched=()) -> None:
        where = f"{self.base}/data/b={batch_id}"
        placed = rows.withColumn("part", F.coalesce(self.part, F.lit(-1)).cast("long"))
        (placed.repartition("part").write.mode("overwrite").option("compression", "zstd")
         .partitionBy("part").parquet(where))
        fs, folder = _folder(self.spark, where)
        wrote = [int(f.getPath().getName()[5:]) for f in fs.listStatus(folder)
                 if f.getPath().getName().startswith("part=")]
        now = {p: b for p, b in parts.items() if p not in touched} | dict.fromkeys(wrote, batch_id)
        (self.spark.createDataFrame(list(now.items()), PARTS_SCHEMA).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.base}/parts/b={batch_id}"))

    def _rows(self, parts: dict[int, int]) -> DataFrame:
        folders = [f"{self.base}/data/b={b}/part={p}" for p, b in sorted(parts.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The rows after the newest batch."""
        return self._with(self._rows(self._parts()), self._over())

    def near(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The table's rows, before the batch, in the parts that ``rows`` (with the
        columns of the key) fall in."""
        hit = self._hit(rows)
        parts = self._parts(before=batch_id)
        over = self._over(before=batch_id)
        if over is not None:
            over = over.filter(F.coalesce(self.part, F.lit(-1)).cast("long").isin(hit))
        return self._with(self._rows({p: parts[p] for p in hit if p in parts}), over)

    def _hit(self, rows: DataFrame) -> list[int]:
        found = rows.select(F.coalesce(self.part, F.lit(-1)).cast("long").alias("part")).distinct().collect()
        return [r["part"] for r in found]  # one number a part

    def _of(self, rows: DataFrame, parts: dict[int, int]) -> dict[int, int]:
        return {p: parts[p] for p in self._hit(rows) if p in parts}

    def _laid(self, before: int | None = None) -> list[int]:
        """The batches laid over the newest list."""
        lists, over = ([b for b in batches_in(self.spark, f"{self.base}/{kind}") if before is None or b < before]
                       for kind in ("parts", "over"))
        return [b for b in over if b > (lists[-1] if lists else -1)]

    def _over(self, before: int | None = None) -> DataFrame | None:
        """The rows laid over the parts: of a key, those of its newest batch."""
        laid = self._laid(before)
        if not laid:
            return None
        read = self.spark.read.schema(self.schema)
        one = [read.parquet(f"{self.base}/over/b={b}").withColumn("_b", F.lit(b)) for b in laid]
        newest = F.max("_b").over(Window.partitionBy(*self.key))
        rows = reduce(DataFrame.unionByName, one)
        if len(laid) > 1:
            rows = rows.withColumn("_newest", newest).filter("_b = _newest")
        return rows.select(*self.schema.names)

    def _with(self, rows: DataFrame, over: DataFrame | None) -> DataFrame:
        if over is None:
            return rows
        return without_keys(rows, over.select(*self.key).distinct(), self.key).unionByName(over)

    def overlay(self, changes: DataFrame, batch_id: int, fold_every: int = FOLD_EVERY) -> None:
        """As ``upsert`` without ``gone``, but only the rows of ``changes`` are written:
        for batches that touch most parts and few rows of each."""
        if len(self._laid(before=batch_id)) + 1 >= fold_every:
            self.upsert(changes, batch_id)
        else:
            (changes.select(*self.schema.names).write.mode("overwrite").option("compression", "zstd")
             .parquet(f"{self.base}/over/b={batch_id}"))

    def upsert(self, changes: DataFrame, batch_id: int, gone: DataFrame | None = None) -> None:
        """Rows of ``changes`` replace those with their key or are added; keys of
        ``gone`` are removed.  ``batch_id`` counts from 1; keys are unique and not
        null in a batch.  Only the parts with a change are read and written."""
        parts = self._parts(before=batch_id)
        keys = changes.select(*self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(*self.key))
        over = self._over(before=batch_id)
        if over is not None:  # goes into the parts with this batch
            changes = changes.select(*self.schema.names).unionByName(over.join(keys.distinct(), self.key, "left_anti"))
            keys = keys.unionByName(over.select(*self.key))
        touched = self._of(keys, parts)
        old = self._rows(touched)
        kept = old.join(keys.distinct(), self.key, "left_anti")
        self._write(kept.select(*self.schema.names).unionByName(changes.select(*self.schema.names)),
                    parts, batch_id, touched)

    def forget(self, keep: int = 2) -> None:
        """Remove the lists before the newest ``keep`` and the files that no kept list names."""
        known = batches_in(self.spark, f"{self.base}/parts")
        used = set()
        for b in known[-keep:]:
            rows = self.spark.read.schema(PARTS_SCHEMA).parquet(f"{self.base}/parts/b={b}").collect()
            used |= {(r["part"], r["at"]) for r in rows}
        for b in known[:-keep]:
            remove(self.spark, f"{self.base}/parts/b={b}")
        for b in batches_in(self.spark, f"{self.base}/over"):
            if known and b <= known[-keep:][0]:
                remove(self.spark, f"{self.base}/over/b={b}")
        for b in batches_in(self.spark, f"{self.base}/data"):
            if b > (known[-1] if known else -1):
                continue  # not finished yet
            fs, folder = _folder(self.spark, f"{self.base}/data/b={b}")
            for f in fs.listStatus(folder):
                name = f.getPath().getName()
                if name.startswith("part=") and (int(name[5:]), b) not in used:
                    fs.delete(f.getPath(), True)
