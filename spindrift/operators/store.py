"""A chunk store over Parquet tables: the filters, listing, upsert, update and delete of a document index."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def condition(df: DataFrame, wanted: Mapping[str, object]) -> Column:
    """Equality for a scalar, membership for a list (any element for an array column); empty values are passed over.

    ``available_int``: 0 asks for hidden rows, else for all that aren't hidden, null included. ``exists`` and ``must_not_exist``
    name a column that must or must not hold something.
    """
    kinds, found = dict(df.dtypes), F.lit(True)
    for name, value in wanted.items():
        if name == "available_int":
            seen = F.coalesce(F.col(name), F.lit(1)) >= 1
            found = found & (~seen if value == 0 else seen)
        elif name in ("exists", "must_not_exist"):
            held = F.col(str(value)).isNotNull()
            found = found & (held if name == "exists" else ~held)
        elif not value and value != 0:
            continue
        elif isinstance(value, (list, tuple, set)):
            many = [F.lit(v) for v in value]
            found = found & (F.arrays_overlap(F.col(name), F.array(*many)) if kinds[name].startswith("array") else F.col(name).isin(*value))
        elif isinstance(value, (str, int, float, bool)):
            found = found & (F.array_contains(F.col(name), value) if kinds[name].startswith("array") else F.col(name) == value)
        else:
            raise TypeError(f"{name}: a condition is a scalar or a list")
    return found


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; of several new rows with a key, one."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    return rows.where(~F.coalesce(condition(rows, wanted), F.lit(False)))


def update(rows: DataFrame, wanted: Mapping[str, object], assign: Mapping[str, object] | None = None, add: Mapping[str, object] | None = None, remove: Mapping[str, object] | None = None) -> DataFrame:
    """Assign columns, append to or remove from array columns in the rows that meet the condition; arrays are sets."""
    hit = F.coalesce(condition(rows, wanted), F.lit(False))
    change: dict[str, Column] = {k: F.lit(v) for k, v in (assign or {}).items()}
    change |= {k: F.array_distinct(F.array_append(F.coalesce(F.col(k), F.array().cast(dict(rows.dtypes)[k])), F.lit(v))) for k, v in (add or {}).items()}
    change |= {k: F.array_remove(F.col(k), v) for k, v in (remove or {}).items()}
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in change.items()})


def look_up(asked: DataFrame, stored: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``asked`` with stored_at, when its key was last stored before or at its time and less than ``seconds`` ago, and hit.

    ``stored`` has (key, at). Time goes in spans of ``seconds``; what is stored counts in its span and the next, so that a key's rows
    are split by span.
    """
    span = F.floor(F.col(at).cast("timestamp").cast("double") / seconds)
    writes = stored.select(key, at).distinct().withColumn("_span", F.explode(F.array(span, span + 1))).withColumn("_stored", F.col(at))
    rows = asked.withColumn("_span", span).withColumn("_asked", F.lit(1)).unionByName(writes, allowMissingColumns=True)
    before = Window.partitionBy(key, "_span").orderBy(F.coalesce("_stored", at), F.coalesce("_asked", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("stored_at", F.max("_stored").over(before)).where("_asked = 1")
    fresh = F.col(at).cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double") < seconds
    last = last.withColumn("hit", F.coalesce(fresh, F.lit(False))).withColumn("stored_at", F.when(F.col("hit"), F.col("stored_at")))
    return last.select(*asked.columns, "stored_at", "hit")


class ChunkStore:
    """Named indexes of a catalog database. An index is a view of its newest version: a write makes a new table and then points the view
    to it in one step, so that readers see the old rows or the new ones, and a failed write leaves the old."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def name(self, index: str) -> str:
        return f"`{self.database}`.`{index}`"

    def exists(self, index: str) -> bool:
        return self.spark.catalog.tableExists(self.name(index))

    def versions(self, index: str) -> list[str]:
        return [r["tableName"] for r in self.spark.sql(f"SHOW TABLES IN `{self.database}` LIKE '{index}__v_*'").collect()]

    def create(self, index: str, rows: DataFrame, partition: str | None = None) -> None:
        """Write ``rows``, which may read the index, as its new version; older versions go afterwards."""
        old, fresh = self.versions(index), f"{index}__v_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name(fresh))
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(index)} AS SELECT * FROM {self.name(fresh)}")
        for version in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(version)}")

    def drop(self, index: str) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name(index)}")
        for version in self.versions(index):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(version)}")

    def read(self, index: str) -> DataFrame:
        return self.spark.table(self.name(index))

    def replace(self, index: str, rows: DataFrame) -> None:
        self.create(index, rows)

    def upsert(self, index: str, rows: DataFrame, key: str = "id") -> None:
        self.replace(index, upsert(self.read(index), rows, key)) if self.exists(index) else self.create(index, rows.dropDuplicates([key]))

    def get(self, index: str, id_: object, key: str = "id") -> DataFrame:
        return self.read(index).where(F.col(key) == id_).limit(1)

    def search(self, index: str, wanted: Mapping[str, object], fields: list[str], order: list[Column] | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        rows = self.read(index)
        rows = rows.where(condition(rows, wanted)).select(*fields)
        rows = rows.orderBy(*order) if order else rows
        rows = rows.offset(offset) if offset else rows
        return rows.limit(limit) if limit else rows
