"""Things a job needs from the cluster it runs on: shared scratch tables, checked broadcasts, hot-key joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys at any size.
HOT_PARTS = 256
SLOTS = 4096
#: A key of no more rows than this is no burden to one task, however few the others are.
HOT_LEAST = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("linkweave.scratch.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="linkweave-")
    spark.conf.set("linkweave.scratch.dir", folder)
    return folder


class Scratch:
    """Tables written to the shared folder, to cut lineage: they outlive lost executors and are computed once.

    ``cut`` writes and reads back; ``drop`` deletes a table no longer needed; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/linkweave-{job}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is not None:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            pass

    def cut(self, df: DataFrame, **measures) -> DataFrame:
        """df, written and read back. ``measured(out)`` has its number of rows and the measures, aggregates over its rows,
        taken while it is written. After a lost executor they can count rows twice: use them to steer, not in results."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[e.alias(k) for k, e in measures.items()])
        watched.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._linkweave_path, out._linkweave_measures = path, seen.get
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_linkweave_path", None):
                self._delete(path)


def measured(df: DataFrame) -> dict:
    """What was measured of a table while it was cut; of other tables the number of rows, which is counted here."""
    return getattr(df, "_linkweave_measures", None) or {"rows": df.count()}


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if df has at most max_rows rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df itself, to be joined by a shuffle."""
    return F.broadcast(df) if fits(df, max_rows) else df


def hot_keys(df: DataFrame, key: str, least: int = HOT_LEAST) -> list:
    """The keys that hold more than 1/HOT_PARTS of the rows, and more than ``least`` rows: fewer than HOT_PARTS values.

    Rows are counted by a hash of the key with SLOTS values first; only keys of slots that full are counted one by one.
    """
    total = measured(df)["rows"]
    if total <= least:
        return []
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    full = (F.col("count") * HOT_PARTS > total) & (F.col("count") > least)
    rows = df.where(F.col(key).isNotNull())
    slots = [r[0] for r in rows.groupBy(slot.alias("s")).count().where(full).collect()]
    return [r[0] for r in rows.where(slot.isin(slots)).groupBy(key).count().where(full).collect()] if slots else []


def skew_safe_lookup(left: DataFrame, key: str, table: DataFrame, table_key: str, how: str = "inner") -> DataFrame:
    """left joined with table on left.key = table.table_key, where table_key is unique and key may be very uneven.

    Rows with a hot key meet a broadcast of the table's rows for the hot keys alone (fewer than HOT_PARTS rows); all
    other rows are joined by a shuffle in which no key holds more than 1/HOT_PARTS of the rows. The result has left's
    columns and table's other columns; how is 'inner' or 'left'. Rows whose key is null match nothing.
    """
    right = table.withColumnRenamed(table_key, key) if table_key != key else table
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right, key, how))


#: Parts into which each side's rows of a hot key fall in skew_safe_join().
GRID = 8


def skew_safe_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined on key, where both sides may hold many rows of one key. Rows whose key is null match nothing.

    Rows of a hot key (fewer than HOT_PARTS keys of either side) fall into GRID parts on each side, and each two parts meet in a
    task of their own, so a key that holds a third of all rows is spread over GRID x GRID tasks."""
    hot = sorted({*hot_keys(left, key), *hot_keys(right, key)})
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)

    def parted(df: DataFrame, mine: str, other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(GRID)).cast("int")
        every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(GRID - 1))).otherwise(F.array(F.lit(0))))
        return df.withColumn(mine, F.when(is_hot, spread).otherwise(F.lit(0))).withColumn(other, every)

    return parted(left, "__l", "__r").join(parted(right, "__r", "__l"), [key, "__l", "__r"]).drop("__l", "__r")
