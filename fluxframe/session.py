"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

#: A key with more rows than this is spread over several tasks.
HOT_KEY_ROWS = "spark.fluxframe.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 2_000_000
#: Tables in the shared folder that are not yet deleted.
SETTLED: list[str] = []


def build_session(app: str = "fluxframe", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library expects.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: both come
    from the submit command and adaptive execution resizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split hot keys even where that costs one more shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # a dimension of every land cell on the globe still fits
        .config("spark.sql.autoBroadcastJoinThreshold", "64m")
        # a join on (key, date) keeps the distribution of a window on key
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a scored row is a window and an image, some ten kilobytes
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may do without; it then gets a fresh folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="fluxframe-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a value depends on how rows were partitioned (range bounds are
    sampled), so that every later use, also after an executor is lost, sees
    the same rows. The written table also gives the optimiser exact sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not SETTLED:
        atexit.register(release, spark)
    SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables settled so far. Nothing that reads them may follow.

    Called at exit while the session still runs. A long-lived session calls it
    between jobs, before it stops.
    """
    if spark.sparkContext._jsc is None:
        return
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while SETTLED:
        path = jvm.org.apache.hadoop.fs.Path(SETTLED.pop())
        path.getFileSystem(conf).delete(path, True)


def counted(observation: Observation, name: str) -> int:
    """A count of an observation; 0 where there were known to be no rows, so that no task ran."""
    row = observation._jo.getRow()
    return row.getLong(row.fieldIndex(name)) if row.length() else 0


def hot_key_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS)))
