"""Lloyd's clustering with the dimensions of the vectors dealt into column blocks.

Vectors become integers (``floor(1024 * x)``), so distances, sums and means are exact and the
result does not hang on the order of additions. The vectors are stored once, cut into blocks of
rows and, within those, into column blocks; the column blocks of one range of dimensions are a
shard. In each round a task of a shard computes, for a block of rows, the exact partial squared
distances to the shard's slice of every centroid. ``reduceByKey`` adds the parts of a block
of rows and takes the nearest centroid. Labels go back to the tasks of every shard, by the
partitioner that dealt the cells, so no vector is shuffled after the first time; each shard adds up
its own columns by label and so updates its own slice. What is shuffled in a round is ``shards``
small integers a vector and centroid, and as many labels; what reaches the driver is each task's
sums of its slice, as many numbers as there are centroids and columns. Nothing hangs on a task's order or place, so a lost executor's blocks
are computed again with the same result.

Defined cases: rows take part if their vector has the asked number of components, none null or
non-finite. A null vec_id takes part but is never a starting centroid unless too few others are
there; rows with equal vec_id start in the order of their components; repeated rows count each.
With fewer vectors than centroids, fewer clusters come out. Ties go to the smaller number; an
empty cluster keeps its centroid. Components of any size are computed exactly (Python integers in
blocks where 64 bits might not do); a distance or inertia beyond a long is null. An empty table
gives no rows; other columns are ignored.
"""

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from pricemill.llm.common import shuffle_partitions, stored

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
SHARDS = 4
_BLOCK_ROWS = 4096
# Differences of components up to this keep 2**20 squares of them within 64 bits
_SAFE = 1 << 20
_LONG = (1 << 63) - 1


def whole(x, scale=SCALE):
    """floor(scale * x), exact for every finite double."""
    return math.floor(x * scale) if abs(x) < 2.0 ** 53 else int(x) * scale


def integer_matrix(values, dimensions, scale=SCALE):
    """Components as whole numbers: 64 bits where they fit well, else Python's integers."""
    flat = np.asarray(values, dtype=np.float64).reshape(-1, dimensions)
    if np.abs(flat).max(initial=0.0) * scale < _SAFE:
        return np.floor(flat * scale).astype(np.int64)
    exact = [[whole(x, scale) for x in row] for row in flat.tolist()]
    return np.array(exact, dtype=object).reshape(-1, dimensions)


def narrow(matrix):
    """The same numbers in 32 bits if all fit."""
    if matrix.dtype == object or not matrix.size:
        return matrix
    fits = -(1 << 31) <= matrix.min() and matrix.max() < 1 << 31
    return matrix.astype(np.int32) if fits else matrix


def squared_distances(matrix, centroids):
    """(rows, centroids) of exact squared distances over the columns at hand."""
    wide = np.array(centroids, dtype=object)
    largest = max((abs(x) for row in centroids for x in row), default=0)
    if matrix.dtype != object and largest < _SAFE:
        wide, matrix = wide.astype(np.int64), matrix.astype(np.int64)
    else:
        matrix = matrix.astype(object)
    found = [((matrix - center) ** 2).sum(axis=1) for center in wide]
    return np.stack(found, axis=1)


def valid_vectors(frame, id_column="vec_id", vector_column="embedding", dimensions=DIMENSIONS):
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    usable = (F.size(vector) == dimensions) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return frame.where(vector.isNotNull() & usable).select(
        F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")
    )


def starting_centroids(vectors, clusters=CLUSTERS, seed=SEED, scale=SCALE):
    """The vectors whose ids have the smallest hashes, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (
        vectors.withColumn("hash", hashed)
        .orderBy(F.asc_nulls_last("hash"), "vector").limit(clusters).collect()
    )
    return [[whole(x, scale) for x in row["vector"]] for row in first]


def blocks(vectors, dimensions=DIMENSIONS, shards=SHARDS, scale=SCALE):
    """(shard, block, ids, matrix): blocks of rows cut by columns; ids lie in the first shard."""
    cuts = column_cuts(dimensions, shards)

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(at, _BLOCK_ROWS)
                matrix = integer_matrix(
                    part.column(1).flatten().to_numpy(zero_copy_only=False), dimensions, scale
                )
                ids = pickle.dumps(part.column(0).to_pylist())
                columns = [pickle.dumps(narrow(matrix[:, a:b])) for a, b in cuts]
                yield pa.record_batch(
                    [
                        pa.array(range(len(cuts)), pa.int32()),
                        pa.array([block] * len(cuts), pa.int64()),
                        pa.array([ids] + [None] * (len(cuts) - 1), pa.binary()),
                        pa.array(columns, pa.binary()),
                    ],
                    ["shard", "block", "ids", "matrix"],
                )
                block += 1

    return vectors.mapInArrow(cut, "shard int, block long, ids binary, matrix binary")


def column_cuts(dimensions, shards):
    """(first, end) of the columns of each shard."""
    shards = max(1, min(shards, dimensions))
    edges = [dimensions * i // shards for i in range(shards + 1)]
    return list(zip(edges, edges[1:]))


def _added(a, b):
    """Partial distances of one block of rows, wider where 32 bits would not do."""
    if a.dtype == object or b.dtype == object:
        return a.astype(object) + b.astype(object)
    return narrow(a.astype(np.int64) + b.astype(np.int64))


def placement(shards, partitions):
    """Where a cell (shard, block) goes: every task has cells of one shard only."""
    width = max(1, partitions // shards)

    def place(cell):
        shard, block = cell
        return shard * width + (block % 1_000_003) % width

    return place


def assigned(cells, centroids, cuts, partitions):
    """(block, (labels, distances)): the nearest centroid of every row."""

    def partial(pair):
        (shard, block), matrix = pair
        a, b = cuts[shard]
        part = [center[a:b] for center in centroids]
        return block, narrow(squared_distances(pickle.loads(matrix), part))

    def nearest(distances):
        labels = distances.argmin(axis=1)  # the first of equal ones
        return labels.astype(np.int32), distances[np.arange(len(labels)), labels]

    return cells.map(partial).reduceByKey(_added, numPartitions=partitions).mapValues(nearest)


def _sums(matrix, labels, clusters):
    """Exact column sums and counts by label, as Python integers."""
    matrix = matrix.astype(object if matrix.dtype == object else np.int64)
    found = []
    for c in range(clusters):
        rows = matrix[labels == c]
        found.append((len(rows), [int(x) for x in rows.sum(axis=0)] if len(rows) else None))
    return found


def _more(a, b):
    return [
        (m + n, x if y is None else y if x is None else [p + q for p, q in zip(x, y)])
        for (m, x), (n, y) in zip(a, b)
    ]


def updated(cells, labels, centroids, cuts, partitions, place):
    """The centroids after each shard has put the floor of its means in its own slice."""
    clusters = len(centroids)

    def to_shards(pair):
        block, (label, _) = pair
        return [((shard, block), label) for shard in range(len(cuts))]

    def column_sums(pairs):
        held, totals = {}, {}
        for (shard, block), value in pairs:  # a partition's labels come before its cells
            if not isinstance(value, bytes):
                held[shard, block] = value
                continue
            found = _sums(pickle.loads(value), held.pop((shard, block)), clusters)
            totals[shard] = _more(totals[shard], found) if shard in totals else found
        return totals.items()

    # the same partitioner on both sides: the union reads labels and cells in one task
    dealt = labels.flatMap(to_shards).partitionBy(partitions, place)
    new = [list(center) for center in centroids]
    slices = {}
    for shard, total in dealt.union(cells).mapPartitions(column_sums).collect():
        slices[shard] = _more(slices[shard], total) if shard in slices else total
    for shard, (a, b) in enumerate(cuts):
        for c, (n, total) in enumerate(slices.get(shard, [])):
            if n:
                new[c][a:b] = [x // n for x in total]
    return new


def cluster(frame, clusters=CLUSTERS, rounds=ROUNDS, dimensions=DIMENSIONS, shards=SHARDS,
            scale=SCALE, seed=SEED, id_column="vec_id", vector_column="embedding"):
    """(rows, centroids): vec_id, cluster and distance of every vector, and the final centroids."""
    spark = frame.sparkSession
    vectors = valid_vectors(frame, id_column, vector_column, dimensions)
    centroids = starting_centroids(vectors, clusters, seed, scale)
    cuts = column_cuts(dimensions, shards)
    cut = stored(blocks(vectors, dimensions, shards, scale))
    # a task for each cell at most
    partitions = max(1, min(shuffle_partitions(spark), cut.count()))
    place = placement(len(cuts), partitions)
    cells = cut.select("shard", "block", "matrix").rdd.map(
        lambda row: ((row[0], row[1]), bytes(row[2]))
    ).partitionBy(partitions, place)
    for _ in range(rounds if centroids else 0):
        labels = assigned(cells, centroids, cuts, partitions)
        moved = updated(cells, labels, centroids, cuts, partitions, place)
        if moved == centroids:
            break  # every further round would give the same
        centroids = moved
    ids = cut.where(F.col("ids").isNotNull()).select("block", "ids").rdd.map(
        lambda row: (row[0], bytes(row[1]))
    ).partitionBy(partitions)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance string"), centroids
    last = assigned(cells, centroids, cuts, partitions)

    def rows(pair):
        _, (names, (labels, distances)) = pair
        # text, so that no distance is cut
        return zip(pickle.loads(names), labels.tolist(), map(str, distances.tolist()))

    found = ids.join(last, partitions).flatMap(rows)
    return spark.createDataFrame(found, "vec_id long, cluster int, distance string"), centroids


def as_long(number):
    return number if number is not None and number <= _LONG else None


def clustered(frame, **choices):
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    found, centroids = cluster(frame, **choices)
    found = stored(found)
    # 38 digits hold the sum of any distances that fit a long
    exact = F.col("distance").try_cast("decimal(38,0)")
    fits = F.max(F.length("distance")) <= 19
    sums = {
        row["cluster"]: int(row["s"]) if row["fits"] else _LONG + 1
        for row in found.groupBy("cluster").agg(F.sum(exact).alias("s"), fits.alias("fits")).collect()
    }
    total = as_long(sum(sums.values()))
    per_cluster = F.lit(None).cast("struct<inertia:bigint,digest:string>")
    for c, center in enumerate(centroids):
        digest = hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()
        values = F.struct(
            F.lit(as_long(sums.get(c, 0))).cast("long").alias("inertia"), F.lit(digest).alias("digest")
        )
        per_cluster = F.when(F.col("cluster") == c, values).otherwise(per_cluster)
    return found.withColumn("of", per_cluster).select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"),
        F.col("of.inertia").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
        F.col("of.digest").alias("centroid_sha256"),
    )
