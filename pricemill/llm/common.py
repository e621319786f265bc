"""What the operators share: stored steps, input columns, Arrow helpers."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from pricemill.session import scratch_path

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["pricemill.llm"])


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame):
    """The frame as a table in the shared folder: lineage ends here, nothing is computed twice."""
    spark = frame.sparkSession
    path = scratch_path(spark, "step")
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def documents_columns(docs, *more):
    """doc_id as long and text as string, besides ``more``; other columns never clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary_path(name):
    """Where the public vocabulary file lies; callers may pass their own path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path):
    """A tokenizer that stays on its own thread: Spark runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unused(frame, name):
    """``name``, longer if the frame has such a column."""
    while name in frame.columns:
        name += "_"
    return name
