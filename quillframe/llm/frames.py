"""What the operators share on the Spark side: written tables, safe names, Arrow maps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..runtime import ship

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine (tests), an own one. On a
    cluster a folder of the driver's machine would be no use to the executors: that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and survives lost
    executors. Such tables hold keys and fingerprints, never texts, and go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Has a table in the shared folder deleted when the session ends."""
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))


def drop_written(df: DataFrame) -> None:
    """Deletes the written table that df reads, once nothing needs it any more."""
    for f in df.inputFiles()[:1]:
        for item in [x for x in _written if f"/{x[1].rpartition('/')[2]}/" in f]:
            _written.remove(item)
            _delete(*item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    ship(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(k1, k2): 128 bits of a row's id (of any type) and text, which name the row: rows with NULL or
    repeated ids are told apart by their texts. Only equal rows have equal names; among 10^12 rows
    two others share one with a probability of about 10^-15."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(F.lit(seed), id_.isNull(), id_, text.isNull(), F.length(text), text).alias(f"k{n}") for n, seed in ((1, 0x51ED27), (2, 0x7F4A7C))]


def whole_ids(df: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers."""
    return isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType))


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long where its type is a whole number; else NULL, so that row_key() alone orders."""
    return F.col(f"`{id_col}`").cast("long") if whole_ids(df, id_col) else F.lit(None).cast("long")


def named(found: DataFrame, df: DataFrame, id_col: str, text_col: str, out: str, k1: str = "k1", k2: str = "k2") -> DataFrame:
    """found with the id, in its own type, of the rows of df that its columns k1 and k2 name."""
    ids = df.select(*row_key(id_col, text_col), F.col(f"`{id_col}`").alias(out)).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.first(out).alias(out))
    return found.join(ids, [k1, k2])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


#: Rows that a worker computes and holds at a time.
ROWS = 256


def add_columns(df: DataFrame, make, fields: list) -> DataFrame:
    """df with the columns that make(batch) -> list of Arrow arrays computes, after those it has.
    A column of the same name (in any case) is replaced; all others pass through as they are."""
    from pyspark.sql.types import StructType

    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    names = keep + [f.name for f in fields]

    def run(it):
        import pyarrow as pa

        for whole in it:
            at = {n: i for i, n in enumerate(whole.schema.names)}
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(at[c]) for c in keep] + list(make(batch)), names=names)

    ship(df.sparkSession)
    return df.mapInArrow(run, StructType([df.schema[c] for c in keep] + list(fields)))


def column(batch, name: str):
    """A column of an Arrow batch by name."""
    return batch.column(batch.schema.names.index(name))


def strings(batch, name: str) -> list:
    return column(batch, name).to_pylist()
