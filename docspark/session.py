"""Session helpers: reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, a Parquet file or folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one is set on one machine (tests); on a
    cluster it is an error, as executors don't share such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _work_folder(spark: SparkSession) -> str:
    """Where this application writes; removed when Python ends."""
    path = f"{shared_folder(spark)}/docspark/{spark.sparkContext.applicationId}"
    if path not in _WORK:
        _WORK.add(path)
        atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str | None = None) -> None:
    """Remove what :func:`written` has left, of this application or at ``path``; tables read from there are gone then."""
    path = path or _work_folder(spark)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended: what is on this machine can still be removed
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that later steps don't compute it anew."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to the executors once per application; its name for ``SparkFiles.get``."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add(key)
    return Path(path).name


_WORK: set[str] = set()
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that don't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docspark-code-")) / "docspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, f"docspark/{path.relative_to(package)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
