"""Session helpers: shipping the package to executors, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package() -> None:
    """Give executors this package, as ``--py-files`` would; once per application."""
    context = SparkSession.active().sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="pyfiles-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints.

    Executors and driver must all see it, so it has to be set. Only a session of one JVM
    (``local`` or ``local[n]``, as in tests) gets a folder of its own where none is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_once(spark: SparkSession, path: str, text: str) -> str:
    """Write a small file unless it exists; returns what the file says afterwards.

    The file appears whole, by a rename that replaces nothing, so of two writers one wins.
    """
    jvm = spark._jvm
    path_of, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    target, staged = path_of(path), path_of(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        stream = fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, target, how)
        except Exception as err:
            fs.delete(staged, False)
            if "FileAlreadyExists" not in str(err):
                raise
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_scratch`` named, once its contents are used."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError("only scratch folders can be removed")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that a lost executor cannot change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
