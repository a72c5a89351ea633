"""Intermediate tables in the folder that all executors share, size-checked broadcasts, joins with hot keys, and slices of Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes that a side may have to be broadcast, by width(); larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a broadcast row takes besides its values.
ROW_BYTES = 48
#: A key with more rows than this, and than one in HOT_SHARE of all, is dealt to SALTS tasks; so there are HOT_SHARE such keys at most.
HOT_ROWS, HOT_SHARE, SALTS = 5_000, 1_000, 32
#: Spark's setting, where it has one, that shuffle files are deleted at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that a batch of rows for a Python worker has.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a column that a worker takes up at a time.
PIECE = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyglass-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{own}")
        root = f"file://{own}"
    return root.rstrip("/")


_saved: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_saved() -> None:
    for spark, path in _saved:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the context may be stopped already
            pass


atexit.register(_delete_saved)


def saved(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and return it read back: its lineage ends there, so a lost executor
    costs no recomputation of what came before. The write's shuffle files go when it ends, as nothing reads them again, and Python workers get batches of about `batch`
    bytes, if given; for that settings of the session are changed while it runs. What dropped() has not deleted by then goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyglass/{label}-{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true"} | ({} if batch is None else {BATCH: str(batch)})
    before = {k: spark.conf.get(k) for k in wanted if spark.conf.isModifiable(k)}
    for k in before:
        spark.conf.set(k, wanted[k])
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyglass_path = path
    _saved.append((spark, path))
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by saved() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tallyglass_path", None)
        if path and (df.sparkSession, path) in _saved:
            _saved.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about: strings and lists by their length, other values 16."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda s, x: s + width(x, kind.elementType)), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16)


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether df's rows take at most `most` bytes as a broadcast side (one pass over df)."""
    each = sum((width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(each)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its bytes allow it, else df as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df) else df


def dealt(by: list[str]) -> Column:
    """A salt that depends on a row's values alone, so that a task that is done again deals alike."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def looked_up(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """left with the columns of right (one row a key) or nulls. right is broadcast if its bytes allow it; else it is copied SALTS
    times and left's rows are dealt to the copies by their columns `by`, so that no key's rows are one task's work."""
    if fits(right):
        return left.join(F.broadcast(right), key, "left")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", dealt(by)).join(copies.hint("merge"), [key, "_salt"], "left").drop("_salt")


def split_join(left: DataFrame, right: DataFrame, key: str, by: list[str], total: int) -> DataFrame:
    """left joined with right (one row a key, with n, the rows that left has of it, of `total` in all; n goes). The rows of
    hot keys are dealt to SALTS copies of right's row by left's columns `by`. At most HOT_SHARE keys are hot, whatever the data, and only these are broadcast:
    the hint keeps Spark from broadcasting right by its estimate, which takes no account of rows that were exploded before."""
    if total <= HOT_ROWS:
        return left.join(right.drop("n"), key)
    hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    flags = F.broadcast(right.where(hot).select(key, F.lit(True).alias("_hot")))
    salted = left.join(flags, key, "left").withColumn("_salt", F.when(F.col("_hot"), dealt(by)).otherwise(0)).drop("_hot")
    copies = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies.drop("n").hint("merge"), [key, "_salt"]).drop("_salt")


def pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of batches, in order and without copying, whose texts in `columns` take `most` bytes at most, or of one row. Spark bounds a batch
    by bytes too, but with room for what it holds only, not for what is made of it."""
    most = PIECE if most is None else most
    for b in batches:
        sizes = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
