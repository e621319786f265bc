"""Payload schema drift: infer what arrives, compare it with what is declared."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.session import scratch_path

_DRIFT_SCHEMA = "path string, kind string, expected string, actual string"


def infer_schema(df, payload):
    """One type that fits every payload: a distributed aggregate, its result a single string."""
    merged = df.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("type")).first()[0]
    return as_type(merged)


def infer_map_values(df, payload, path):
    """The type of an object whose keys are data (dates): a map to the merged value type.

    Keys are exploded before the types are merged, so the type does not grow with the dates.
    """
    entries = df.select(
        F.explode(
            F.try_variant_get(F.try_parse_json(payload), path, "map<string,variant>")
        ).alias("key", "value")
    )
    merged = entries.agg(F.schema_of_variant_agg("value").alias("type")).first()[0]
    return T.MapType(T.StringType(), as_type(merged))


def infer_with_map(df, payload, field):
    """The payload's type with one field, an object keyed by data, taken as a map.

    The field's values and the remaining fields are inferred separately, so the merged type
    stays as small as the contract.
    """
    entries = df.select(
        F.explode(
            F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
        ).alias("key", "value")
    )
    merged = (
        entries.filter(F.col("key") != field)
        .groupBy("key")
        .agg(F.schema_of_variant_agg("value").alias("type"))
    )
    others = [T.StructField(key, as_type(found)) for key, found in merged.collect()]
    inner = infer_map_values(df, payload, f"$.{field}")
    return T.StructType([*others, T.StructField(field, inner)])


def as_type(variant_type):
    """The aggregate's result as a data type; objects are structs."""
    ddl = variant_type.replace("OBJECT<", "STRUCT<").replace("ARRAY<VOID>", "ARRAY<STRING>")
    return T.DataType.fromDDL(f"v {ddl}")["v"].dataType


def fields(data_type, path="$"):
    """Every path of a type with the type found there."""
    if isinstance(data_type, T.StructType):
        found = {path: "object"}
        for field in data_type.fields:
            found |= fields(field.dataType, f"{path}.{field.name}")
        return found
    if isinstance(data_type, T.ArrayType):
        return {path: "array"} | fields(data_type.elementType, f"{path}[]")
    if isinstance(data_type, T.MapType):
        return {path: "map"} | fields(data_type.valueType, f"{path}{{}}")
    return {path: "number" if isinstance(data_type, T.NumericType) else data_type.typeName()}


def field_table(spark, data_type):
    rows = sorted(fields(data_type).items())
    return spark.createDataFrame(rows, "path string, type string")


def diff(spark, expected, actual):
    """Fields added, removed or of another kind, as rows."""
    want, got = fields(expected), fields(actual)
    rows = []
    for path in sorted(want.keys() | got.keys()):
        if path not in want:
            rows.append((path, "added", None, got[path]))
        elif path not in got:
            rows.append((path, "removed", want[path], None))
        elif want[path] != got[path]:
            rows.append((path, "retyped", want[path], got[path]))
    return spark.createDataFrame(rows, _DRIFT_SCHEMA)


# Keys of an object are data if there are this many and an object has less than half of them.
MAP_KEYS = 8
MAP_PRESENCE = 0.5
_PATHS_SCHEMA = "path string, kind string, seen long"


# Payloads are first taken apart to this depth, then to twice as much while any goes deeper.
FIRST_DEPTH = 4


def infer_paths(df, payload, max_depth=32):
    """(path, kind, seen) of everything inside the payloads, merged over all of them.

    One pass takes the payloads apart and counts their nodes by the keys that lead to them; only
    payloads deeper than ``FIRST_DEPTH`` ask for another. The counts are stored, and paths are made
    of them level by level: of an object the statistics of its keys are aggregated, and if its keys
    are data (see ``MAP_KEYS``) it is a map, and they become one path before the next level is made.
    So what reaches the driver has a row per path and kind of the contract, however many keys there
    are. Text that is no JSON counts as kind ``invalid`` at the root; a null payload as nothing.
    """
    values = df.where(F.col(payload).isNotNull()).select(F.try_parse_json(payload).alias("_value"))
    depth = min(FIRST_DEPTH, max_depth - 1)
    while True:
        path = scratch_path(df.sparkSession, "nodes")
        counted = _node_counts(values, depth)
        counted.write.parquet(path)
        nodes = df.sparkSession.read.schema(counted.schema).parquet(path)
        deepest = nodes.agg(F.max(F.size("steps"))).first()[0] or 0
        closed = nodes.where((F.size("steps") == depth) & F.col("head").isin("OBJECT", "ARRAY")).isEmpty()
        if closed or depth == max_depth - 1:
            break
        depth = min(2 * depth, max_depth - 1)
    level, maps = nodes.withColumn("path", F.lit("$")), set()
    for at in range(deepest):
        step, size = F.get("steps", F.lit(at)), F.size("steps")
        children = level.where((size == at + 1) & step.isNotNull())
        objects = level.where((size == at) & (F.col("head") == "OBJECT"))
        here = _map_paths(
            children.groupBy("path", step.alias("key")).agg(F.sum("seen").alias("n")),
            dict(objects.groupBy("path").agg(F.sum("seen")).collect()),
        )
        child = F.concat(F.lit("."), step)
        if here:
            child = F.when(F.col("path").isin(sorted(here)), "{}").otherwise(child)
        child = F.when(step.isNull(), "[]").otherwise(child)
        level = level.withColumn(
            "path", F.when(size > at, F.concat("path", child)).otherwise(F.col("path"))
        )
        maps |= here
    kinds = level.groupBy("path", _kind("head").alias("kind")).agg(F.sum("seen").alias("seen"))
    found = [
        (path, "map" if kind == "object" and path in maps else kind, seen)
        for path, kind, seen in kinds.collect()
    ]
    return df.sparkSession.createDataFrame(sorted(found), _PATHS_SCHEMA)


def _node_counts(values, depth):
    """(steps, head, seen): nodes down to ``depth`` by their keys (NULL in an array) and type.

    Every row of the exploded payloads is a leaf and the nodes above it; a node is counted with
    the first leaf below it. Only leaves are asked for their type.
    """
    explode = values.sparkSession.tvf.variant_explode_outer
    taken, keys, heads = values, [], []
    for at in range(1, depth + 1):
        taken = taken.lateralJoin(explode(F.col("_value").outer()))
        inner = F.when(F.col("key").isNull(), "ARRAY").otherwise("OBJECT")
        taken = taken.select(
            *keys, *heads, F.col("key").alias(f"_key{at}"), F.col("pos").alias(f"_pos{at}"),
            *[f"_pos{i}" for i in range(1, at)], F.col("value").alias("_value_below"),
            F.when(F.col("pos").isNotNull(), inner).otherwise(_head("_value", at == 1))
            .alias(f"_head{at - 1}"),
        ).withColumnRenamed("_value_below", "_value")
        keys, heads = [*keys, f"_key{at}"], [*heads, f"_head{at - 1}"]
    taken = taken.select("*", _head("_value", depth == 0).alias(f"_head{depth}"))
    first, counted = F.lit(True), []
    for at in range(depth, -1, -1):
        head, steps = F.col(f"_head{at}"), F.array(*keys[:at]).cast("array<string>")
        counted.append(
            F.when(first & head.isNotNull(), F.struct(steps.alias("steps"), head.alias("head")))
        )
        first = first & (F.coalesce(F.col(f"_pos{at}"), F.lit(0)) == 0) if at else first
    nodes = taken.select(F.explode(F.array(*counted)).alias("node")).where("node IS NOT NULL")
    return nodes.groupBy("node.steps", "node.head").agg(F.count("*").alias("seen"))


def _head(value, root):
    """The first word of a variant's type; of none, NULL, at the root ``INVALID``."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.coalesce(name, F.lit("INVALID")) if root else name


def _kind(head):
    """The kind of a type: object, array, string, number, boolean, null or invalid."""
    head = F.col(head)
    return (
        F.when(head.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "number")
        .when(head == "VOID", "null").otherwise(F.lower(head))
    )


def _map_paths(keys, objects):
    """Paths of objects whose keys are many and seldom the same; ``keys`` are (path, key, n)."""
    if not objects:
        return set()
    stats = keys.groupBy("path").agg(F.count("*").alias("keys"), F.sum("n").alias("entries"))
    return {
        row["path"] for row in stats.where(F.col("keys") >= MAP_KEYS).collect()
        if row["entries"] < MAP_PRESENCE * row["keys"] * objects[row["path"]]
    }


def merged_kinds(paths):
    """One kind a path: nulls give way, differing kinds are ``mixed``."""
    known = F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))
    return paths.groupBy("path").agg(
        F.when(F.size(known) == 0, "null").when(F.size(known) == 1, F.element_at(known, 1))
        .otherwise("mixed").alias("kind"),
        F.sum("seen").alias("seen"),
    )


def diff_paths(expected, actual):
    """Paths added, removed or of another kind; both sides are (path, kind) rows."""
    want = expected.select("path", F.col("kind").alias("expected"))
    got = actual.select("path", F.col("kind").alias("actual"))
    kind = F.when(F.col("expected").isNull(), "added").when(F.col("actual").isNull(), "removed")
    return want.join(got, "path", "full").where(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    ).select("path", kind.otherwise("retyped").alias("kind"), "expected", "actual")
