"""Session factory and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrata", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra settings by keyword, dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only on one machine, and only where neither that setting nor a checkpoint directory is set (as in tests),
    a local folder is made and set for the session. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _own_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}"
    context = spark.sparkContext
    if not getattr(context, "_lodestrata_cleans", False):  # what this application wrote goes when it stops
        context._lodestrata_cleans, stop = True, context.stop

        def clean_and_stop() -> None:
            try:
                forget(spark)
            finally:
                stop()

        context.stop = clean_and_stop
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results not yet read from it become unreadable. Done of
    itself when the Spark context is stopped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors,
    and keeps costly columns (token counts, canonical texts) from being computed twice. ``by``: a column of few values;
    readers that ask for some of them read only those."""
    path = new_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def files_below(spark: SparkSession, path: str) -> int | None:
    """How many data files a table folder has, by one listing on the driver; None for a single file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return None
    return sum(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def ship(spark: SparkSession) -> None:
    """Send the package's own code to the Python workers, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestrata-code-")) / "lodestrata.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._lodestrata_shipped = True
