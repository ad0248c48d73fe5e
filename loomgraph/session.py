"""Session helpers: shared checkpoint folder, written intermediate tables, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_WRITTEN: list[str] = []


def build_session(app: str = "loomgraph", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine assumes (AQE on, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only for a local master."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set; it must name a folder shared by all executors")
    root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` once as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes intermediate tables (as `materialize` returned them) that others have superseded; nothing may read them any more."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this session has written as intermediate results; results that read them must have been used before."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


SALT_ROWS = 1_000_000


def salts_for(table: DataFrame) -> int:
    """Parts for the hot keys of a written table: so many that a key with a third of its rows gives no task more than SALT_ROWS / 3 of
    them, at least 8. The rows are counted from the footers of its files."""
    return max(8, -(-table.count() // SALT_ROWS))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose `big` side may hold a third of its rows under one key: the key is split into `salts` parts.

    `small` must be unique on `keys`; it is repeated `salts` times, so the cost is salts x |small|, never a pair explosion.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


HOT_SHARE = 1000


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, counts: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """As salted_join, but only keys with at least one row of HOT_SHARE are split, so the rows of `small` for all other keys are not repeated.

    `counts` (keys.., n) has the rows of `big` per key (or more), `rows` their sum; so at most HOT_SHARE keys are hot, and they are what is broadcast.
    """
    salts = max(8, -(-rows // SALT_ROWS))
    hot = F.broadcast(counts.where(F.col("n") >= max(rows / HOT_SHARE, 2)).select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    right = small.join(hot, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
