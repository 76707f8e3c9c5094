"""Where intermediate tables live, and how lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master with none configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
    return sc.getCheckpointDir()


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/tabulon-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame) -> DataFrame:
    """Write the table once as parquet in the shared folder and read it from there on.

    Lineage ends here, so a lost executor costs a read. Later steps read only the columns they
    use, and the size of the files tells the planner which joins may broadcast.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this process has written in the shared folder, once nothing reads it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
