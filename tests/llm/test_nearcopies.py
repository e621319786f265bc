"""Near copies against all pairs, in groups large, hot and just below the limit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.llm import nearcopies

SCHEMA = "doc_id long, text string"


def edited(words, edits, rng):
    words = list(words)
    for place in rng.choice(len(words), edits, replace=False):
        words[place] = f"edit{rng.integers(1 << 40)}"
    return " ".join(words)


def plain_roots(texts):
    """The smallest index of each component of pairs at the limit or above."""
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * either:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket_limit", [16, 1024])
@pytest.mark.parametrize("edits", [2, 3, 4])
def test_one_base_many_edits(spark, bucket_limit, edits):
    """Copies of one base: alike at two edits, chains at three, apart at four."""
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in rng.integers(0, 9000, 220)]
    texts = [edited(base, edits, rng) for _ in range(90)]
    docs = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs, bucket_limit).collect()}
    assert kept == {7 * i for i in set(plain_roots(texts))}


def stage_rows(spark, n):
    """Rows that the passes emit for n texts that are all a little less alike than the limit."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 9000, 300)]
    docs = spark.createDataFrame([(i, edited(base, 4, rng)) for i in range(n)], SCHEMA)
    placed = nearcopies.placed(docs, "file", "row")
    nodes = nearcopies.distinct_nodes(nearcopies.sketched(placed, "file", "row"))
    buckets = nearcopies.bucket_members(nodes)
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = buckets.join(sizes, "key")
    edges = nearcopies.candidate_edges(members, nodes).count()
    none = spark.createDataFrame([], "node long, root long")
    dealt = nearcopies.across_blocks(members, none).count()
    return members.count(), edges, dealt


def test_rows_grow_in_proportion(spark):
    few, many = stage_rows(spark, 250), stage_rows(spark, 500)
    for a, b in zip(few, many):
        assert b <= 2.6 * a, (few, many)


def test_members_of_the_main_root_do_not_meet(spark):
    """A bucket of one large group and a few others is dealt in proportion."""
    def dealt(n):
        members = spark.range(n).selectExpr("id AS node", "7L AS key", "0 AS band", f"{n}L AS n")
        labels = spark.range(5, n).selectExpr("id AS node", "5L AS root")
        return nearcopies.across_blocks(members, labels, 64).count()

    assert dealt(4000) <= 2.5 * dealt(2000)


def test_very_long_texts(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 150_000)]
    texts = [" ".join(words), edited(words, 100, rng), edited(words, 9000, rng)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs).collect()}
    assert kept == set(plain_roots(texts))


def test_rows_of_one_id_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (None, "a b c d e f g", "z"),
            (None, "other words stand here all alone", "n"), (3, None, "e"), (2, "", "e"), (2, " ", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    for name in ("row", "node", "root", "key", "digest", "sketch", "band"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept = nearcopies.keep_one(docs.coalesce(1))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["file"]) for r in kept.collect()), key=str) == [
        (1, "x"), (2, "e"), (None, "n")
    ]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(20)]
    counts = nearcopies.shared_counts(sets, width=7)
    for i, j in itertools.permutations(range(20), 2):
        assert counts[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_fingerprints_give_candidates(spark):
    """The pigeonhole over SimHashes finds exactly the texts whose fingerprints are close."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 9000, 400)]
        texts += [" ".join(base), edited(base, 1, rng), edited(base, 3, rng)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    placed = nearcopies.placed(docs, "file", "row")
    nodes = nearcopies.distinct_nodes(nearcopies.sketched(placed, "file", "row"))
    prints = {r["node"]: r["fingerprint"] % (1 << 64) for r in nodes.collect()}

    def roots(edges):
        root = {node: node for node in prints}
        for _ in prints:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    close = [
        (a, b) for a, b in itertools.combinations(prints, 2)
        if (prints[a] ^ prints[b]).bit_count() <= nearcopies.DISTANCE
    ]
    found = [(r["a"], r["b"]) for r in nearcopies.fingerprint_edges(nodes).collect()]
    assert len(close) > 30 and roots(found) == roots(close)
