"""Session defaults used by the bench and the tests."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "lucidform") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``; a private folder is made
    only where that is unset (tests on one machine).
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    where = str(sc._jsc.sc().getCheckpointDir().get() if not sc._jsc.sc().getCheckpointDir().isEmpty() else configured or "")
    if configured is None and not sc.master.startswith("local") and urlparse(where).scheme in ("", "file"):
        raise ValueError("executors don't share a local folder: set spark.checkpoint.dir to one that they do")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if configured is None:
            import tempfile

            configured = tempfile.mkdtemp(prefix="lucidform-ckpt-")
        sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, survives lost executors, ends the lineage."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Contexts that have the package already.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context: they needn't have it installed or start in its folder.

    The archive is named by its content and written to the shared folder, so a session that finds it uses it.
    """
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(root.parent))), f.read_bytes())
    target = f"{checkpoint_dir(spark)}/lucidform-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
