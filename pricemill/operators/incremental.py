"""Incremental loading: watermarks, filters, column sync and keyed upserts."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.constants import LOOKBACK_DAYS
from pricemill.functions.windows import columns
from pricemill.session import scratch_path
from pricemill.sources import evolving


def high_watermark(df, column, name="high_watermark"):
    """Largest value loaded so far; one row, NULL for an empty table."""
    return df.agg(F.max(column).alias(name))


def table_watermark(spark, table, column="date"):
    """The watermark of a catalog table as a value, or None when absent or empty."""
    if not spark.catalog.tableExists(table):
        return None
    return high_watermark(spark.read.table(table), column).first()[0]


def filter_new(source, target, source_column, target_column=None, mode="strict",
               lookback_days=LOOKBACK_DAYS):
    """Source rows newer than the target.

    ``strict``: above the target's maximum; ``inclusive``: from it on; ``lookback``: above
    the maximum less some days. An empty target lets every row through. The edge is a scalar
    subquery of the column's own type, so the filter reaches the scan of the source.
    """
    data_type = source.schema[source_column].dataType
    edge = F.max(target_column or source_column)
    if mode == "lookback":
        edge = edge - F.make_dt_interval(days=F.lit(lookback_days))
    mark = target.agg(F.coalesce(edge.cast(data_type), _smallest(data_type)).alias("mark"))
    value = F.col(source_column)
    return source.filter(
        value >= mark.scalar() if mode == "inclusive" else value > mark.scalar()
    )


def _smallest(data_type):
    """A value below any real one, for targets that hold nothing yet."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("0001-01-01").cast(data_type)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.lit(float("-inf")).cast(data_type)
    return F.lit(-(2**63)).cast(data_type)


def sync_columns(target, updates):
    """The target with exactly the columns of the updates: new ones NULL, others dropped."""
    return target.select(
        *[
            F.col(f.name) if f.name in target.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in updates.schema.fields
        ]
    )


def upsert(target, updates, keys, sync=True):
    """The target with rows replaced or added by key.

    With ``sync`` the columns are exactly those of the updates. Without, they are those of both: a
    replaced row keeps what the updates have no column for, and a target without one of their
    columns has NULL there. NULL keys are equal. The anti join compares keys only, so a small batch of
    updates is broadcast by Spark's own size check and the target is not shuffled.
    """
    names = columns(keys)
    changed = updates.select(*[F.col(k).alias(f"_changed_{k}") for k in names])

    def same(row, other, prefix):
        return reduce(
            lambda a, b: a & b, [row[k].eqNullSafe(other[f"{prefix}{k}"]) for k in names]
        )

    kept = target.join(changed, same(target, changed, "_changed_"), "left_anti")
    if sync:
        return sync_columns(kept, updates).unionByName(updates)
    known = {c.lower() for c in updates.columns}
    only_there = [c for c in target.columns if c.lower() not in known]
    if only_there:
        old = target.select(*[F.col(k).alias(f"_old_{k}") for k in names], *only_there)
        updates = updates.join(old, same(updates, old, "_old_"), "left").drop(
            *[f"_old_{k}" for k in names]
        )
    return kept.unionByName(updates, allowMissingColumns=True)


def upsert_partitions(spark, path, updates, keys, partition, sync=False):
    """Upsert into a Parquet table, rewriting only the partitions the updates touch.

    The updates are written to the scratch folder first, so their plan runs once and may itself
    read the table. The merge is then written with a dynamic partition overwrite, whose files
    replace the old ones only when the whole job has succeeded. The partition must follow
    from the key. Rows of the NULL partition are merged like any other. Two updates of one key
    are an error, as no order decides between them.

    Columns are added as the updates bring them; columns that only the table has stay, in
    all partitions. With ``sync`` they are dropped, in all partitions too, by declaration:
    no partition is rewritten for it. Returns the number of updates.
    """
    names = columns(keys)
    staged = scratch_path(spark, "updates")
    updates.hint("rebalance", F.col(partition)).write.partitionBy(partition).parquet(staged)
    fresh = spark.read.schema(updates.schema).parquet(staged)
    by_key = fresh.groupBy(*names).agg(
        F.count("*").alias("_n"), F.max(F.col(partition).isNull()).alias("_null")
    )
    found = by_key.agg(F.max("_n"), F.max("_null"), F.sum("_n")).first()
    if (found[0] or 0) > 1:
        raise ValueError(f"updates repeat a key of {names}")
    known = evolving.schema_of(spark, path)
    if known is None:
        raise ValueError(f"no table at {path}")
    schema = evolving.evolved(spark, path, known, updates.schema, sync)
    target = evolving.read(spark, path, schema)
    # an equality join prunes partitions at run time; NULL needs a filter of its own
    touched = target.join(fresh.select(partition).distinct(), partition, "left_semi")
    if found[1]:
        touched = touched.unionByName(target.where(F.col(partition).isNull()))
    merged = evolving.conformed(upsert(touched, fresh, names, sync=False), schema)
    (
        merged.hint("rebalance", F.col(partition))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    evolving.declare(spark, path, schema)
    return found[2] or 0
