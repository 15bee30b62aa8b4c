"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, ANSI arithmetic and adaptive execution.

    ``master`` stays unset on a cluster, where spark-submit names it. ``conf`` keys
    use ``__`` for dots (``spark__sql__shuffle__partitions="64"``).

    Python workers need this package: local ones find it through the path set here; on a cluster it is installed
    (``pip install .``) or sent with ``spark-submit --py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
