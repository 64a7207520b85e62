"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A JSON object that repeats a key has its last value, as in JavaScript.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the library's defaults; `conf` overrides them.

    On a cluster leave `master` unset and name a shared folder in
    `spark.checkpoint.dir`. Size `spark.sql.shuffle.partitions` so that a
    partition holds 100-200 MB; AQE merges the ones that turn out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
