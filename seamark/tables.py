"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, as counted over its rows, up to which a written table is broadcast; beyond that Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A folder of our own serves only a single-machine session that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="seamark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It runs the plan once, cuts the lineage, and what was written survives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(df: DataFrame) -> str:
    """The folders that the plan of ``df`` reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            out.append(leaf.relation().location().rootPaths().mkString(" "))
    return " ".join(out)


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(work: Callable) -> Callable:
    """Delete the tables that ``durable`` made within ``work`` and that the DataFrames it returns don't read."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        outer = _made.get()
        token = _made.set([])
        try:
            found = work(*args, **kwargs)
            frames = [x for x in (found if isinstance(found, tuple) else (found,)) if isinstance(x, DataFrame)]
            read, made = " ".join(map(_roots, frames)), _made.get()
        finally:
            _made.reset(token)
        spark = SparkSession.active()
        for path in made:
            if path.rsplit("/", 1)[1] not in read:
                removed(spark, path)
            elif outer is not None:
                outer.append(path)
        return found

    return run


def _weight(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.StructType):
        return functools.reduce(lambda a, f: a + _weight(value[f.name], f.dataType), kind.fields, F.lit(8).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        inner = F.lit(0).cast("bigint")
        return F.coalesce(F.aggregate(value, inner, lambda n, x: n + _weight(x, kind.elementType)), inner) + 24
    if isinstance(kind, T.MapType):
        return _weight(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.lit(8).cast("bigint")


def bytes_of(written: DataFrame) -> int:
    """About the bytes that all rows take in memory, by reading them."""
    row = functools.reduce(lambda a, f: a + _weight(F.col(f"`{f.name}`"), f.dataType), written.schema.fields, F.lit(16).cast("bigint"))
    return written.agg(F.sum(row)).first()[0] or 0


def if_small(written: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``written`` (a table that ``durable`` made), marked for broadcast if its rows take at most ``most`` bytes."""
    return F.broadcast(written) if bytes_of(written) <= most else written
