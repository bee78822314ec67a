"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the session names none and all runs in one process (tests, a
    notebook), a temporary folder is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ondaframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _written(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ondaframe/{spark.sparkContext.applicationId}"


def stage_out(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, never a recomputation.  What
    is written stays until release(), since later frames may read it.
    """
    spark = df.sparkSession
    path = f"{_written(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that this application has staged: frames that were built on it can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_written(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scored_schema(docs: DataFrame, keep: list[str], more: str) -> StructType:
    """Columns `keep` of docs, and more (as DDL); names may not clash."""
    fields, added = docs.select(*keep).schema.fields, StructType.fromDDL(more).fields
    clash = {f.name.lower() for f in fields} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    return StructType([*fields, *added])
