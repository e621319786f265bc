"""Bronze tables: stamping, writing, appending and counting what was written."""

from functools import reduce

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricemill.sources import evolving


def scan_table(spark, name):
    """A catalog table by qualified name, or Parquet files by path."""
    return spark.read.parquet(name) if "/" in name else spark.read.table(name)


def declare_table(spark, name, schema, location, partition=()):
    """A catalog table with its columns before it has rows; its schema (database) is made too."""
    database = name.rpartition(".")[0]
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition)})" if partition else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({fields}) USING parquet{by} LOCATION '{location}'"
    )


def quoted(name):
    return ".".join(f"`{part}`" for part in name.split("."))


def load_table(df, name):
    """Append rows to a declared table: columns by name, those that the rows lack are NULL."""
    known = df.sparkSession.read.table(quoted(name)).schema
    there = set(df.columns)
    rows = Observation("loaded")
    df.select(
        *[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in known]
    ).observe(rows, F.count(F.lit(1)).alias("rows")).write.insertInto(quoted(name))
    return rows.get["rows"]


def stamp_load(df, loaded_at=None):
    """Add the date of the row and the time of its load (default: now)."""
    now = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    return df.withColumn("date", F.to_date("time")).withColumn("ingest_date_time", now)


def stamp_batch(df, batch_id, processed_at=None):
    """Replace the load time by the processing time and add the batch id."""
    now = F.current_timestamp() if processed_at is None else F.lit(processed_at).cast("timestamp")
    return df.drop("ingest_date_time").withColumn("ingest_date_time", now).withColumn(
        "dbt_batch_id", F.lit(batch_id)
    )


def write_partitioned(df, target, mode="overwrite", partition=("month",)):
    """Write by month (a day per partition would mean one tiny file per row of a series).

    The rebalance hint groups rows by partition before the write and lets adaptive execution
    split the large ones, so a month with a third of all rows is written by many tasks. A path
    declares its schema, a batch without rows included; appended rows may have more columns than
    the table, or fewer. Returns the number of rows, observed while writing instead of by running
    the plan again.
    """
    spark = df.sparkSession
    rows = Observation("written")
    out = df.withColumn("month", F.trunc("date", "month")) if "month" in partition else df
    at_path = "/" in target
    known = evolving.schema_of(spark, target) if at_path and mode == "append" else None
    if known is None:
        schema = evolving.plain(out.schema)
    else:
        schema = evolving.evolved(spark, target, known, out.schema)
        out = evolving.conformed(out, schema)
    writer = (
        out.hint("rebalance", *[F.col(p) for p in partition])
        .observe(rows, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .partitionBy(*partition)
    )
    if at_path:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)
    written = rows.get["rows"]
    if at_path:
        evolving.declare(spark, target, schema)
    return written


def append_evolving(df, target, partition=("month",)):
    """Append rows that may have more columns than the table."""
    return write_partitioned(df, target, "append", partition)


def scan_evolving(spark, path):
    """Read a table whose files differ in columns; what a file lacks is NULL."""
    return evolving.read(spark, path)


def inventory(tables):
    """Row count and columns of each named frame, as one result."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile(df, time, value, by=()):
    """Rows, time range and value range of a batch."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )
