"""Written intermediate tables. They cut long lineage and survive the loss of
executors, because they live in the folder all executors share."""

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session that names none, as a
    local test does, gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Records in one file of an entity table. Spark reads small files many to a task, but
# never more than make up 128 MB with 4 MB added for each.
ROWS_PER_FILE = 20_000


def stage_spread(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`stage`, in as many files as the rows ask for: entity tables are
    short in bytes, and one file of all rows would be one task of every later step."""
    stored = stage(df, f"{label}-whole")
    n_files = math.ceil(stored.count() / ROWS_PER_FILE)
    return stage(stored.repartition(n_files), label) if n_files > 1 else stored


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
