"""What a session needs to run this package's code on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that
    Python functions find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="sextant-code-"), "sextant_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sextant", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this
    machine is seen by all of them."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def folder(spark: SparkSession) -> str:
    """This application's folder in the shared one that ``spark.checkpoint.dir``
    names; a temporary one only where the session names none and is one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sextant-"))
        root = _own[0]
    return f"{root.rstrip('/')}/sextant-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote aside.  Results are lazy and read it, so
    only their user knows when: call it once they are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
