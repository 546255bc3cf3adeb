"""What the operators of this subpackage share: word patterns, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, white space between words, and what stands between the words of op1.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: No table of more rows than this is broadcast, nor a staged one of more bytes; beyond it the same join shuffles, or runs in blocks.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

#: Spark's settings while a table is staged: the shuffle files of a query are removed at its end, and not when the driver
#: collects garbage; and Python gets batches of so many rows and bytes, which the executor holds beside its heap.
WHILE_STAGED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z alone are lowered. Texts without other than ASCII take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, delimiter: str = SPACE) -> Column:
    return F.array_remove(F.split(text, delimiter), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a temporary one of this machine if executors run in the driver (tests), else an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wavequill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives the executors that wrote it.

    The shuffles of the write are of no use once the table is there, and go with its end.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in WHILE_STAGED}
    try:
        for key, value in WHILE_STAGED.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wavequill-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def unstage(*tables: DataFrame) -> None:
    """Removes tables that stage() returned, once all that reads them is staged itself."""
    for df in tables:
        _delete(df.sparkSession, df.staged_at)


def clean(spark: SparkSession) -> None:
    """Removes this application's staged tables. Frames that still read them fail afterwards."""
    _delete(spark, _own_dir(spark))


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than bound rows, and no more than BROADCAST_BYTES where it is a staged table;
    else as it is: then the join shuffles. Tables with arrays or texts have to be staged ones."""
    if hasattr(df, "staged_at") and _bytes(df.sparkSession, df.staged_at) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the columns, so that rows with null keys meet too."""
    return all_of([a[n].eqNullSafe(b[n]) for n in names])
