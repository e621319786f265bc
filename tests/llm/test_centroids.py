"""Rounds of the clustering against plain loops over whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters, rounds, dimensions):
    kept = []
    for name, vector in rows:
        if vector is None or len(vector) != dimensions:
            continue
        if all(x is not None and math.isfinite(x) for x in vector):
            kept.append((name, [centroids.whole(x) for x in vector]))
    order = sorted(
        kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    )
    centers = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for i in range(len(centers)):
            mine = [v for (_, v), label in zip(kept, labels) if label == i]
            if mine:
                centers[i] = [sum(column) // len(mine) for column in zip(*mine)]
    last = [(name, *nearest(v)[::-1]) for name, v in kept]
    total = sum(d for _, _, d in last)
    inertia = {i: sum(d for _, c, d in last if c == i) for i in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(
        ((name, c, d, inertia[c], total, digest[c]) for name, c, d in last), key=str
    )


def found(frame, **choices):
    return sorted((tuple(r) for r in centroids.clustered(frame, **choices).collect()), key=str)


@pytest.mark.parametrize("shards", [1, 3, 6])
def test_against_loops(spark, monkeypatch, shards):
    monkeypatch.setattr(centroids, "_BLOCK_ROWS", 7)
    rng = np.random.default_rng(shards)
    rows = [(int(i), [float(x) for x in rng.normal(i % 3, 1, 6)]) for i in range(90)]
    nan, inf = float("nan"), float("inf")
    rows += rows[:4] + [(3, [0.0] * 6), (None, [1.0] * 6), (None, [-0.0001] * 6)]
    rows += [(200, None), (201, [1.0] * 5), (202, [nan] * 6), (203, [inf] + [0.0] * 5),
             (204, [None] + [0.0] * 5), (205, [])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).withColumn(
        "vector", F.lit(0)).repartition(3)
    choices = dict(clusters=5, rounds=6, dimensions=6)
    assert found(frame, shards=shards, **choices) == plain(rows, 5, 6, 6)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, clusters=8, dimensions=2) == plain(rows, 8, 10, 2)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert centroids.clustered(frame).count() == 0
    assert centroids.clustered(frame).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]


def test_components_beyond_64_bits(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, 1e300, -1e300, 0.25, 0.5, 1e18, 2.0 ** 53])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(frame, clusters=3, rounds=4, dimensions=2, shards=2)
    want = plain(rows, 3, 4, 2)
    assert [(r[0], r[1], r[5]) for r in got] == [(r[0], r[1], r[5]) for r in want]
    long = (1 << 63) - 1
    assert [r[2] for r in got] == [r[2] if r[2] <= long else None for r in want]
    assert [r[3] for r in got] == [r[3] if r[3] <= long else None for r in want]


def test_ties_go_to_the_smaller_number():
    distances = centroids.squared_distances(np.array([[0], [2]]), [[1], [-1], [1]])
    assert distances.argmin(axis=1).tolist() == [0, 0]
    wide = centroids.squared_distances(np.array([[0]]), [[1 << 40]])
    assert wide[0, 0] == 1 << 80


def test_narrow_keeps_values():
    for values in ([1, -5], [1 << 31, 0], [-(1 << 31) - 1], [], [1 << 70]):
        kind = object if any(abs(v) > 1 << 62 for v in values) else np.int64
        assert centroids.narrow(np.array(values, dtype=kind)).tolist() == values
