"""Parquet tables that declare their schema, so that columns and empty tables are not lost.

A table is a folder of Parquet files with its schema in ``_schema`` (a folder Spark's readers pass
over): one JSON row a version, the newest counts. A table exists from its first declaration on,
also before any row does. Columns may be added; a narrower number may become a wider one; a column
may be dropped, which takes one declaration and rewrites no data. For that a column has a name in
the files besides its own: a column that is added again after a drop gets a new name there, so
values from before the drop do not come back. What a file lacks is NULL.

Data is written first and declared after, so a reader between the two sees the old schema and a
writer that failed can run again. One writer at a time is assumed, as for any Parquet folder.
"""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "_schema"
_IN_FILES = "in_files"
_WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
}


def versions(spark, path):
    """(version, schema as JSON) of every declaration, or None where there is no table."""
    folder = f"{path.rstrip('/')}/{FOLDER}"
    try:
        return spark.read.schema("version long, schema string").json(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _newest(spark, path):
    found = versions(spark, path)
    row = found and found.agg(F.max("version"), F.max_by("schema", "version")).first()
    return (row[0], T.StructType.fromJson(json.loads(row[1]))) if row and row[1] else (0, None)


def declared(spark, path):
    """The newest declared schema, or None where there is no table."""
    return _newest(spark, path)[1]


def in_files(field):
    """The column's name in the files."""
    return field.metadata.get(_IN_FILES, field.name)


def declare(spark, path, schema):
    """Add a version if the schema is new; names in the files stay with their columns."""
    version, known = _newest(spark, path)
    if known is not None and known.jsonValue() == schema.jsonValue():
        return
    spark.createDataFrame(
        [(version + 1, json.dumps(schema.jsonValue()))], "version long, schema string"
    ).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/{FOLDER}")


def _used_names(spark, path):
    found = versions(spark, path)
    if found is None:
        return set()
    schemas = [T.StructType.fromJson(json.loads(r[0])) for r in found.select("schema").collect()]
    return {in_files(field).lower() for schema in schemas for field in schema}


def _wider(known, new, name):
    if new == known or type(new) in _known_narrower(known):
        return known
    if type(new) in _WIDER.get(type(known), ()):
        return new
    raise ValueError(f"column {name} is {known.simpleString()}, not {new.simpleString()}")


def _known_narrower(kind):
    return [narrow for narrow, wide in _WIDER.items() if type(kind) in wide]


def evolved(spark, path, known, arriving, sync=False):
    """The known schema with the arriving columns added and widened.

    With ``sync`` the columns are exactly the arriving ones, the others are dropped. Columns are
    matched by name, in any case.
    """
    arriving_by_name = {field.name.lower(): field for field in arriving}
    fields = []
    for field in known:
        new = arriving_by_name.pop(field.name.lower(), None)
        if new is not None:
            kind = _wider(field.dataType, new.dataType, field.name)
            fields.append(T.StructField(field.name, kind, True, field.metadata))
        elif not sync:
            fields.append(field)
    used = _used_names(spark, path) | {in_files(field).lower() for field in known}
    for field in arriving_by_name.values():
        name, turn = field.name, 1
        while name.lower() in used:
            name, turn = f"{field.name}__{turn}", turn + 1
        metadata = {_IN_FILES: name} if name != field.name else {}
        fields.append(T.StructField(field.name, field.dataType, True, metadata))
    return T.StructType(fields)


def plain(schema):
    """A frame's schema as a table declares it: nullable, without the frame's metadata."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def schema_of(spark, path):
    """The declared schema; for a folder without one, what its files have; else None."""
    found = declared(spark, path)
    if found is not None:
        return found
    try:
        return plain(spark.read.option("mergeSchema", True).parquet(path).schema)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def exists(spark, path):
    """Whether a table was declared at the path."""
    return declared(spark, path) is not None


def read(spark, path, schema=None):
    """The rows of a table under ``schema`` (default: its own)."""
    schema = schema or schema_of(spark, path)
    stored = T.StructType([T.StructField(in_files(f), f.dataType, True) for f in schema])
    return spark.read.schema(stored).parquet(path).select(
        *[F.col(f"`{in_files(f)}`").alias(f.name) for f in schema]
    )


def conformed(frame, schema):
    """The frame in the columns of ``schema``, by their names in the files; missing ones NULL."""
    there = {c.lower() for c in frame.columns}
    return frame.select(
        *[
            (F.col(f"`{f.name}`") if f.name.lower() in there else F.lit(None))
            .cast(f.dataType).alias(in_files(f))
            for f in schema
        ]
    )


def create(spark, path, schema):
    """Declare a table without rows."""
    declare(spark, path, plain(schema))


def overwrite(spark, path, frame, partition, declare_empty=True):
    """Replace a table by the rows of a frame; returns their number.

    The empty frame leaves a table without rows, or with ``declare_empty`` off no table.
    """
    rows = Observation("written")
    (
        frame.hint("rebalance", F.col(partition)).observe(rows, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").partitionBy(partition).parquet(path)
    )
    written = rows.get["rows"]
    if declare_empty or written:
        declare(spark, path, plain(frame.schema))
    return written
