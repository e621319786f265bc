"""Inference by path rows: merged kinds, maps found by their keys, a bounded result."""

import json
from collections import Counter

from pyspark.sql import functions as F

from pricemill.operators import drift
from tests.conftest import rows


def paths(spark, *payloads):
    found = [(p if p is None or isinstance(p, str) else json.dumps(p),) for p in payloads]
    return drift.infer_paths(spark.createDataFrame(found, "payload string"), "payload")


def test_kinds_are_merged(spark):
    found = paths(spark, {"a": 1, "b": [1.5, "x", None]}, {"a": None, "c": {"d": True}}, None, "{bad")
    assert set(rows(found)) == {
        ("$", "object", 2), ("$", "invalid", 1), ("$.a", "number", 1), ("$.a", "null", 1),
        ("$.b", "array", 1), ("$.b[]", "number", 1), ("$.b[]", "string", 1), ("$.b[]", "null", 1),
        ("$.c", "object", 1), ("$.c.d", "boolean", 1),
    }
    kinds = dict(rows(drift.merged_kinds(found), "path", "kind"))
    assert kinds["$.a"] == "number" and kinds["$.b[]"] == "mixed" and kinds["$"] == "mixed"


def test_a_hundred_thousand_keys_are_one_path(spark):
    payloads = spark.range(1000).select(
        F.to_json(F.map_from_entries(F.transform(
            F.sequence(F.lit(0), F.lit(99)),
            lambda i: F.struct(F.concat(F.lit("k"), F.col("id") * 100 + i), F.struct(i.alias("v"))),
        ))).alias("payload")
    )
    found = drift.infer_paths(payloads, "payload")
    assert rows(found) == [("$", "map", 1000), ("${}", "object", 100_000), ("${}.v", "number", 100_000)]


def test_fields_that_are_always_there_are_no_map(spark):
    wide = {f"f{i}": i for i in range(40)}
    found = dict(rows(paths(spark, wide, wide, wide), "path", "kind"))
    assert found["$"] == "object" and found["$.f39"] == "number"


def test_maps_inside_maps(spark):
    many = [{f"d{i}_{j}": {f"q{i}_{j}_{k}": 1.5 for k in range(9)} for j in range(9)} for i in range(5)]
    assert [r[:2] for r in rows(paths(spark, *many))] == [
        ("$", "map"), ("${}", "map"), ("${}{}", "number")
    ]


def test_drift(spark):
    old = drift.merged_kinds(paths(spark, {"a": 1, "b": "x"}))
    new = drift.merged_kinds(paths(spark, {"a": "1", "c": []}))
    assert rows(drift.diff_paths(old, new)) == [
        ("$.a", "retyped", "number", "string"), ("$.b", "removed", "string", None),
        ("$.c", "added", None, "array"),
    ]


def test_nothing(spark):
    assert paths(spark, None).count() == 0


def plain_nodes(value, path="$"):
    """(path, kind) of every node, by walking the value."""
    kinds = {dict: "object", list: "array", int: "number", str: "string"}
    yield path, kinds[type(value)]
    children = value.items() if isinstance(value, dict) else ()
    for key, child in children:
        yield from plain_nodes(child, f"{path}.{key}")
    for child in value if isinstance(value, list) else ():
        yield from plain_nodes(child, f"{path}[]")


def test_deeper_than_the_first_pass(spark):
    deep = 1
    for i in range(9):
        deep = [deep, {}, "x"] if i % 2 else {"k": deep, "z": []}
    counts = Counter([*plain_nodes(deep)] * 2)
    assert rows(paths(spark, deep, deep)) == sorted((*node, n) for node, n in counts.items())


def test_payloads_are_read_once(spark):
    """Depth does not multiply the work: each payload is parsed once, not twice a level and branch."""
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    texts = spark.range(20).selectExpr("""'{"a": {"b": [1, {"c": null}]}}' AS payload""")
    seen = texts.mapInArrow(counted, "payload string")
    assert drift.infer_paths(seen, "payload").count() == 6
    assert parsed.value == 20
