"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone. When shards are
appended, a row either stays or goes to a new shard. Rows are numbered within each shard without
gathering a shard anywhere: ranges of rows are ranked each on its own and shifted by the counts
of the ranges before them.

Defined cases: a null key counts as key 0; a null text has no bytes and checksum 0. Rows are
numbered by (doc_id, checksum, size), nulls first, and rows equal in all of these are
interchangeable. Empty tables give no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, stored, unused

# Fixed values of the published algorithm (Lamping and Veach)
MULTIPLIER = 2862933555777941757


def jump_hash(keys, shards):
    """Shards of an array of unsigned 64-bit keys."""
    keys = np.array(keys, dtype=np.uint64)
    shard = np.zeros(len(keys), dtype=np.int64)
    following = np.zeros(len(keys), dtype=np.int64)
    moving = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(moving := moving[following[moving] < shards]):
            shard[moving] = following[moving]
            keys[moving] = keys[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
            above = (keys[moving] >> np.uint64(33)).astype(np.float64) + 1
            following[moving] = ((shard[moving] + 1) * (float(1 << 31) / above)).astype(np.int64)
    return shard


def with_shards(rows, key, counts):
    """``rows`` with one int column per (name, number of shards) of ``counts``."""
    fields = rows.schema.fields
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
        + [f"`{name}` int" for name in counts]
    )
    index = rows.columns.index(key)

    def assign(batches):
        for batch in batches:
            keys = pc.fill_null(batch.column(index), 0).to_numpy(zero_copy_only=False)
            keys = keys.astype(np.int64).view(np.uint64)
            added = [pa.array(jump_hash(keys, n).astype(np.int32)) for n in counts.values()]
            yield pa.record_batch(
                list(batch.columns) + added, names=batch.schema.names + list(counts)
            )

    return rows.mapInArrow(assign, schema)


def shard_documents(docs, shards=8):
    """doc_id, size, text_crc32, law, shard, slot and the shard among one more."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents_columns(docs).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    )
    sharded = with_shards(rows, "doc_id", {"shard": shards, "grown_shard": shards + 1})
    return with_slots(sharded, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def with_slots(sharded, order):
    """Number the rows of each ``shard`` from 0 by ``order``.

    ``tie`` cuts runs of equal rows into ranges too; both steps are stored, so a lost executor
    does not deal ranges anew.
    """
    base = stored(sharded.withColumn("tie", F.monotonically_increasing_id()))
    ranged = stored(
        base.repartitionByRange(*order, "tie").withColumn("block", F.spark_partition_id())
    )
    before = Window.partitionBy("shard").orderBy("block")
    offsets = (
        ranged.groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.sum("n").over(before) - F.col("n"))
        .select(F.col("shard").alias("o_shard"), F.col("block").alias("o_block"), "offset")
    )
    within = Window.partitionBy("block", "shard").orderBy(*order, "tie")
    ranked = ranged.withColumn("place", F.row_number().over(within))
    joined = ranked.join(
        offsets, (ranked.shard == offsets.o_shard) & (ranked.block == offsets.o_block)
    )
    return joined.withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long"))


def write_shards(docs, path, shards=8):
    """The documents themselves, one folder ``shard=N`` per shard; returns the folders' column.

    Where ``docs`` has a column of that name, the caller's stays and the folders get a longer one.
    """
    key, shard = unused(docs, "shard_key"), unused(docs, "shard")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    frame = with_shards(keyed, key, {shard: shards}).drop(key)
    frame.hint("rebalance", shard).write.partitionBy(shard).parquet(path)
    return shard
