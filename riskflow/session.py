"""Session helpers.

``get_session`` is for tests, notebooks and the benchmark. On a cluster the
caller owns the session; the only thing the library asks of it is a
checkpoint directory on shared storage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "riskflow", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("RISKFLOW_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint directory, setting one only when the cluster set none.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that wins.
    Only an unset session (local tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not (conf_dir or fallback or sc.master.split("[")[0] == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    target = conf_dir or fallback or tempfile.mkdtemp(prefix="riskflow-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


# Fixed value: the largest method, in bytes of code, that the JVM compiles.
COMPILED_METHOD = 8000


def limit_methods(spark: SparkSession) -> None:
    """Keep generated methods to a size that the JVM compiles, where the session
    leaves the limit at its default (the largest that a class file can hold).
    A wide projection in one method runs interpreted, at half the speed;
    beyond the limit Spark runs the stage operator by operator."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, str(COMPILED_METHOD))


# Fixed value: the shuffle bytes a task takes.
PARTITION_BYTES = 16 * 1024 * 1024


def limit_partitions(spark: SparkSession) -> None:
    """Ask for shuffle partitions of ``PARTITION_BYTES`` where the session leaves
    the size at its default (64 MB). The panel's narrow rows grow several times
    after the exchange: a few large tasks leave cores idle in the last wave."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(name, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        spark.conf.set(name, str(PARTITION_BYTES))


def write_stage(df, name: str, **options):
    """Write ``df`` as Parquet under the checkpoint directory and read it back:
    a stage boundary whose lineage is a scan of shared files. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskflow-{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Fixed value: rows of a table of blocks that are handed to Python at a time.
BLOCKS_READ = 8


@contextmanager
def block_scans(spark: SparkSession):
    """Scans that run inside read written blocks of rows, a task per file. Spark packs files
    by bytes, and rows with noise take many times the bytes of others: the task with
    the plainest rows would hold most of them, and a pass over blocks takes its time by the row.
    Blocks are read one by one and handed on a few at a time, as one is as large as thousands
    of plain rows."""
    ours = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
            "spark.sql.parquet.enableVectorizedReader": "false",
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCKS_READ)}
    before = {name: spark.conf.get(name) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def ensure_package_on_workers(spark: SparkSession) -> None:
    """Ship this package to the Python workers (``addPyFile`` of a zip), once
    per SparkContext. Only the operators that run Python on executors
    (``mapInPandas``) need it; on a cluster where the package is installed the
    shipped copy is simply the same code."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_riskflow_shipped", False):
        return
    import riskflow
    pkg = os.path.dirname(os.path.abspath(riskflow.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="riskflow-pyfiles-"), "riskflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._riskflow_shipped = True
