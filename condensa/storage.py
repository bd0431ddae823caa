"""Tables between the steps of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Setting with the number of partitions that tables of few row groups are spread over; see spread.
PARTITIONS = "condensa.scan.partitions"

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in spark.checkpoint.dir.

    Only a local session that has none set gets a temporary one; a cluster without the
    setting is an error, since a folder of one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="condensa-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for held in _open[-1:]:
        held.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within the block are deleted at its end: what is to stay must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = path or new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the setting PARTITIONS says; df itself where it isn't set.

    A small file often is one row group, which one task reads whatever the split size. Only
    who runs such files sets this: it is a shuffle of all rows, whatever the table's size.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df


#: Steps of a plan that leave each row of a file one row or none, the same whenever they run.
_ROW_BY_ROW = {"LogicalRelation", "Project", "Filter", "Repartition", "RepartitionByExpression", "SubqueryAlias"}


def _row_by_row(plan) -> bool:
    if plan.getClass().getSimpleName() not in _ROW_BY_ROW:
        return False
    children = plan.children()
    return all(_row_by_row(children.apply(k)) for k in range(children.size()))


def placed(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(df, the same with columns __file and __at that tell its rows apart whenever it is read).

    Where df is a scan of files, filtered perhaps, those are a row's file and its number
    there, and nothing is written. Any other frame is written once, since its rows may come
    otherwise next time, or several from one row of a file.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")]
    plan = df._jdf.queryExecution().analyzed()
    if plan.deterministic() and _row_by_row(plan):
        with contextlib.suppress(AnalysisException):  # other formats than Parquet don't number rows
            return df, df.select("*", *place)
    df = written(df, name)
    return df, df.select("*", *place)


def in_order(df: DataFrame, *by: str | Column, name: str = "order") -> DataFrame:
    """df with a column pos, a row's number from 0 in the order of by.

    The rows are sorted by ranges and written; what one task adds up is the number of rows of
    each file, of which there are as many as a shuffle has partitions.
    """
    rows = placed(written(df.orderBy(*by), name), name)[1]
    part = F.regexp_extract("__file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__file").agg(F.count("*").alias("__n")).withColumn("__part", part)
    bases = bases.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), "__file").withColumn("pos", F.col("__base") + F.col("__at")).drop("__file", "__at", "__base")
