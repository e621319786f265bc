"""Exact top-k search by inner product.

Vectors become integers (``floor(256 * x)``), so scores are exact and ties are real ties. Queries
are dealt into blocks and candidates into shards, both by hash; each (block, shard) cell is one
matrix product, cut into tiles, of which only the best k per query leave. A tree of group merges
joins the lists. Cells have bounded size, so neither side is ever collected or broadcast.

Defined cases: a row takes no part if its id is null, or its vector is null or holds null or
non-finite components. Only vectors of equal length are compared. Rows with the same id and
vector count once; rows that share an id are one item whose score is the best of its vectors.
Components beyond a long saturate, and so do scores. Empty tables give no rows; other columns
are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.llm.common import shuffle_partitions, stored

_LIST_SCHEMA = "query_id long, vec_id long, score long, shard int"


def integer_vectors(frame, id_column="vec_id", vector_column="embedding", scale=256):
    """Distinct (id, integer vector) rows of the valid vectors, with a hash to deal them by."""
    vector = F.col(vector_column)
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return (
        frame.where(F.col(id_column).isNotNull() & vector.isNotNull() & finite)
        .select(
            F.col(id_column).cast("long").alias("id"),
            F.transform(
                vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
            ).alias("v"),
        )
        .distinct()
        .withColumn("h", F.xxhash64("id", "v"))
    )


def top_k(vectors, is_query, k=5, block_rows=16384, shard_rows=16384, fan=64):
    """(query_id, rank, vec_id, score): the k best other items for each query row.

    ``vectors`` comes from ``integer_vectors``; ``is_query`` is a condition on ``id``.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors)
    counts = vectors.agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")
    ).first()
    blocks = max(1, -(-counts["q"] // block_rows))
    spread = min(shuffle_partitions(spark), -(-counts["n"] // 512))
    shards = max(1, -(-counts["n"] // shard_rows), spread)
    # new names on both sides: cogroup confuses columns of one parent
    queries = vectors.where(is_query).select(
        F.col("id").alias("q_id"), F.col("v").alias("q_v"),
        F.pmod("h", F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    candidates = vectors.select(
        F.col("id").alias("c_id"), F.col("v").alias("c_v"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int").alias("shard"),
    )

    def cell(key, left, right):
        return best_of_cell(left, right, k, key[1].as_py())

    lists = (
        queries.groupBy("block", "shard")
        .cogroup(candidates.groupBy("block", "shard"))
        .applyInArrow(cell, _LIST_SCHEMA)
    )
    return merge_lists(lists, k, shards, fan)


def merge_lists(lists, k, shards, fan):
    """Merge the lists of up to ``fan`` shards at a time until one list per query is left."""
    while True:
        shards = -(-shards // fan)
        lists = lists.withColumn("shard", F.expr(f"shard div {fan}").cast("int"))
        best = (
            lists.repartition("query_id", "shard")
            .groupBy("query_id", "shard", "vec_id")
            .agg(F.max("score").alias("score"))
        )
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def best_of_cell(left, right, k, shard, tile_queries=1024, tile_candidates=4096):
    """The k best candidates of each query in one cell, as an Arrow table."""
    found = []
    for dimension, q_ids, q in by_dimension(left, "q_id", "q_v"):
        for other, c_ids, c in by_dimension(right, "c_id", "c_v"):
            if other != dimension:
                continue
            order = np.argsort(c_ids, kind="stable")
            c_ids, c = c_ids[order], c[order]
            for i in range(0, len(q_ids), tile_queries):
                for j in range(0, len(c_ids), tile_candidates):
                    found.append(
                        best_of_tile(
                            q_ids[i:i + tile_queries], q[i:i + tile_queries],
                            c_ids[j:j + tile_candidates], c[j:j + tile_candidates], k,
                        )
                    )
    columns = [np.concatenate([f[n] for f in found]) if found else [] for n in range(3)]
    types = (pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(column, type=kind) for column, kind in zip(columns, types)]
    arrays.append(pa.array(np.full(len(arrays[0]), shard, dtype=np.int32)))
    return pa.table(arrays, names=["query_id", "vec_id", "score", "shard"])


def by_dimension(part, id_name, vector_name):
    """(dimension, ids, matrix) for each vector length in an Arrow table."""
    if not part.num_rows:  # an empty side comes without columns
        return
    vectors = part.column(vector_name).combine_chunks()
    ids = part.column(id_name).to_numpy()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for dimension in np.unique(lengths):
        rows = np.nonzero(lengths == dimension)[0]
        cells = starts[rows][:, None] + np.arange(dimension)[None, :]
        yield int(dimension), ids[rows], flat[cells.astype(np.int64)]


def products(q, c):
    """Exact inner products: in doubles while they stay below 2**53, else in Python integers."""
    largest = [max(int(m.max()), -int(m.min())) if m.size else 0 for m in (q, c)]
    if largest[0] * largest[1] * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of_tile(q_ids, q, c_ids, c, k):
    """Partial selection in one tile; ``c_ids`` ascend and may repeat."""
    scores = products(q, c)
    starts = np.concatenate([[0], np.nonzero(np.diff(c_ids))[0] + 1])
    if len(starts) < len(c_ids):
        scores, c_ids = np.maximum.reduceat(scores, starts, axis=1), c_ids[starts]
    take = min(k + 1, len(c_ids))  # one more, as the query's own id goes
    least = np.partition(scores, len(c_ids) - take, axis=1)[:, len(c_ids) - take]
    rows, columns = np.nonzero(scores >= least[:, None])
    values, ids = scores[rows, columns], c_ids[columns]
    other = ids != q_ids[rows]
    rows, values, ids = rows[other], values[other], ids[other]
    # ~v falls as v grows and, unlike -v, has no overflow
    order = np.lexsort((ids, ~values, rows))
    rows, values, ids = rows[order], values[order], ids[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return q_ids[rows[keep]], ids[keep], values[keep]
