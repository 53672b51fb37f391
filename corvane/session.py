"""Session factory shared by the bench, the tests and interactive use."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import SparkSession


def get_spark(app: str = "corvane", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution on; ``conf`` overrides any setting.

    On a cluster use the session that the launcher made: no operator of this
    package depends on a setting made here.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small inputs keep all cores busy
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, unless they find it on PYTHONPATH or in the working folder."""
    import tempfile
    import zipfile
    from pathlib import Path

    root, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    found = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in found or getattr(sc, "_corvane_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "corvane").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(name))
    sc._corvane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the cluster shares; a temporary one only where none is set and the master is local."""
    import tempfile

    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corvane-")
    if not found.isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df):
    """``df`` with its lineage cut by a checkpoint in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df, *by, **options):
    """``df`` written once as parquet to the folder that the cluster shares, in folders by the columns ``by`` and with the writer's ``options``, and read back.

    For what several branches of a plan read and is dear to compute, as tokens
    are. Written tables survive lost executors; they go when the driver ends.
    """
    import atexit
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/stored-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    atexit.register(unstore, out)
    return out


def unstore(df, part: str = "") -> None:
    """Deletes the files, or those of the folder ``part``, of a table that ``stored`` gave and that no plan reads any more."""
    try:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{df._stored_at}/{part}" if part else df._stored_at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended first
        pass


@contextlib.contextmanager
def freed(spark):
    """Within it, a query's shuffle files are deleted when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def spread(df):
    """``df`` of files, dealt out anew if it has fewer files than the session has cores.

    A file of one row group is read by one task, which would then do all the
    work on its texts. Larger inputs are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
