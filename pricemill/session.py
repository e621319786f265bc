"""Session helpers: settings for the engine and the shared scratch folder."""

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores="*", shuffle_partitions=8, **settings):
    """A session for tests and the bench; on a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark):
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where there is no other machine.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    return _local_root()


@functools.cache
def _local_root():
    return tempfile.mkdtemp(prefix="pricemill-")


def scratch_path(spark, name):
    """A fresh path below the scratch root; never reused, so reruns cannot collide."""
    return f"{scratch_root(spark)}/pricemill/{name}-{uuid.uuid4().hex}"
