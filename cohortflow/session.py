"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "cohortflow", **conf: str) -> SparkSession:
    """A session with a UTC clock and adaptive execution with skewed-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the one the cluster names, else a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cohortflow-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)  # a scratch folder ends with the process
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Later steps then share one set of rows, read only the columns they need, and plan with its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("table-"):
            raise ValueError(f"not a stored table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder.rsplit('/', 1)[-1]}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
