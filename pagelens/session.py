"""Session helpers: the configuration the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every operator in the package assumes. They are session-level, cheap to set, and
# safe to set repeatedly.
REQUIRED_CONF = {
    # duplicate attribute names: the last one wins (the tree library replaces on duplicates)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    # JSON-LD blocks with repeated keys still parse (last key wins, as in Python's json)
    "spark.sql.variant.allowDuplicateKeys": "true",
    # rows handed to Python at once: a worker holds one batch, whatever the table's size
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # a shuffled join whose smaller side is small in every partition looks it up and leaves the larger one unsorted
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
}

# Settings for a fresh local session (tests, bench). On a cluster the operator sets its own.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # the report is some 40,000 column calls; recording the call site of each doubles the time to build it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators need (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "pagelens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(k, v)
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_conf(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; that setting always wins. Only a local session
    (tests) gets a fresh scratch folder of its own; on a cluster executors could not share one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pagelens-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for an intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Rows of a stored table that one task is given at most, on average.
ROWS_A_TASK = 200_000


def spread(df: DataFrame) -> DataFrame:
    """A table scan dealt over all cores, and over more tasks as its rows get more.

    A split is cut by its bytes, yet what is done with a row (a page rendered and parsed, a URL checked) costs the same however
    well the row is compressed: a split of keys alone holds millions of them. Scans with at most half as many splits as the
    session has cores, or with more than ``ROWS_A_TASK`` rows a split, are dealt out before that work; so the longest task stays
    as long as it is when the table grows. The rows are counted from the files' footers."""
    if df.isStreaming:
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    tasks = max(cores if 2 * splits <= cores else splits, -(-df.count() // ROWS_A_TASK))
    return df if tasks == splits else df.repartition(tasks)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, name)))
