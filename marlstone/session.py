"""Session helpers: shared folder, lineage cuts and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster, master stays unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    return b.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the setting is absent a folder of this machine is made and set, on a local master only: on a cluster
    other nodes would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext.getCheckpointDir()
        if have:
            return have
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    Survives lost executors, is compressed and columnar, and later readers prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/marlstone/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that materialize wrote in this process, once their results are stored; how many there were."""
    jvm = spark.sparkContext._jvm
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, spread over all cores if its scan has fewer tasks than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are going to be scanned."""
    return spread(table(spark, sf_dir, name))


def task_count(df: DataFrame) -> int:
    """Shuffle width of the session."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
