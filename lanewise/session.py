"""Session defaults and lineage cutting."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def configure(builder):
    """Settings the engine relies on; sizes and partition counts stay with the cluster."""
    return (builder
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            # windows here cost far more time than bytes: keep their partitions small
            .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16MB")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.sql.streaming.stateStore.providerClass",
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``. Only a local session, where one machine does all, may use a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder; later plans read only the columns they need from the files."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = 5_000) -> DataFrame:
    """Dimension table for joins: broadcast when a count proves it small, else the build side of a shuffled hash join.

    Without a hint Spark guesses from file sizes, and behind an ``explode`` it
    may take the large side for the small one.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df.hint("shuffle_hash")
