"""What several operators need: stored steps, lookups against small tables, rows told apart by their id."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xrel.session import shared_dir

# Tables up to this many rows may be broadcast; callers count them first.
BROADCAST_ROWS = 100_000
# A hot key's rows are spread over this many tasks when its lookup table is too large to broadcast.
SALTS = 32
NO_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow, after Spark has been given this package to hand to its Python workers."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_xrel_shipped", False):
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='xrel-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._xrel_shipped = True
    return df.mapInArrow(function, schema)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor then costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that stored() has written, once all that reads it is stored too."""
    files = table.inputFiles()
    if files:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drops_shuffles(operator: Callable) -> Callable:
    """An operator on docs whose steps are all stored: the shuffle files of a step go when it ends, not when the driver
    happens to collect its garbage."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        conf, name = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name, None)
        conf.set(name, "true")
        try:
            return operator(docs, *args, **named)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    return run


def lookup(rows: DataFrame, table: DataFrame, key: str, n_table: int, how: str = "left") -> DataFrame:
    """Join rows with a table of unique keys: broadcast while its counted size is within the bound, salted beyond."""
    if n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def with_row_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text as (id, n, doc_id, text), then columns `more`: id and n are never null and together unique.

    A null doc_id sorts after all others. Rows that repeat a doc_id are numbered by text; where no doc_id
    repeats, as one narrow count shows, n is 0 and nothing is sorted.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "doc_id", "text", *more)
    repeated = rows.groupBy("id").count().where("count > 1").isEmpty() is False
    if not repeated:
        return rows.select("id", F.lit(0).alias("n"), "doc_id", "text", *more)
    order = Window.partitionBy("id").orderBy(F.col("text").asc_nulls_first())
    return rows.select("id", (F.row_number().over(order) - 1).alias("n"), "doc_id", "text", *more)


def words(text: str | Column) -> Column:
    """Words between ASCII white space, as an array; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
