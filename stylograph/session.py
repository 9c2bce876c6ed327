"""Sessions with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "stylograph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` overrides (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as a file of the job; needed once a session where it is not installed on every node."""
    root = os.path.dirname(os.path.abspath(__file__))
    name = "stylograph-package.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="stylograph-"), name)
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith((".py", ".npz")):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.join("stylograph", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
