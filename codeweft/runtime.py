"""Session-level helpers: lineage cuts into shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` where set, else, in local mode only, a private one."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweft-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, whatever is written there; removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/codeweft-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Unlike a cached frame this survives the loss of executors, keeps column pruning and
    statistics, and ends the lineage. The files are removed by ``discard`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/codeweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = (files, hadoop)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised frame that nothing lazy reads any more."""
    files, path = df._written_to
    files.delete(path, True)


def _bytes_of(value: Column, kind: DataType) -> Column:
    """Bytes of a value in memory, nested ones included, counted generously."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return 24 + F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + 8 + _bytes_of(x, kind.elementType)), F.lit(0))
    if isinstance(kind, MapType):
        return _bytes_of(F.map_keys(value), ArrayType(kind.keyType)) + _bytes_of(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where a count over all rows and columns proves the bound; else plain.

    ``df`` should be materialised, since it is read once for the measurement. Beyond the bound
    the join stays a shuffle join, which AQE splits where a key is hot.
    """
    width = sum((_bytes_of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(32))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def first_version(df: DataFrame, keys: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key: the version loaded first (ties: smallest remaining values)."""
    rest = [c for c in df.columns if c not in keys and c != at]
    picked = df.groupBy(*keys).agg(F.min(F.struct(F.col(at), *[F.col(c) for c in rest])).alias("_v"))
    return picked.select(*keys, F.col(f"_v.{at}").alias(at), *[F.col(f"_v.{c}").alias(c) for c in rest])


def last_version(df: DataFrame, keys: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key: the version loaded last (ties: largest remaining values)."""
    rest = [c for c in df.columns if c not in keys and c != at]
    picked = df.groupBy(*keys).agg(F.max(F.struct(F.col(at), *[F.col(c) for c in rest])).alias("_v"))
    return picked.select(*keys, F.col(f"_v.{at}").alias(at), *[F.col(f"_v.{c}").alias(c) for c in rest])
