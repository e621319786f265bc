"""Near-duplicates by SimHash, searched with the generalised pigeonhole principle.

Fingerprints of 64 bits are first made distinct, so copies cost nothing further. Correlated bits
are grouped into partitions. If two fingerprints differ in at most ``distance`` bits and the
thresholds of m partitions add up to ``distance - m + 1``, then in some partition the two differ
by no more than its threshold (-1 leaves a partition out). A dynamic programme picks the
thresholds, and the number of partitions, with the fewest estimated candidates and probes. The
estimates come from all fingerprints. Probes with equal keys share a bucket and are verified.
Buckets above ``bucket_limit`` are split again by the same principle over the bits their key
leaves open, until they are small: nothing is dropped. Only a spanning forest of each bucket's
links is emitted, and links are contracted to components in a few rounds.

Words and shingles: A-Z lower-cased, runs of characters other than space and ``\\t \\n \\v \\f \\r``,
three words to a shingle. Defined cases: a null or empty text has fingerprint zero, which links
like any other; a text of one or two words is one shingle; a null doc_id takes the component of
its fingerprint and is never a component's id unless all are null. Empty tables give no rows.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, stored, unused

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
BUCKET_LIMIT = 2048
_CHUNK = 1 << 15


def fingerprint(text):
    """The SimHash of one text as a signed 64-bit integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    span = min(SHINGLE_WORDS, len(words))
    hashes = [
        xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[span:])
    ]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes):
    """The bits set in over half of the unsigned 64-bit hashes, as a signed integer."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i:i + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs, name="fingerprint"):
    """All columns of ``docs`` and their fingerprint (long), called ``name``."""
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
        + [f"`{name}` long"]
    )
    at = docs.columns.index("text")

    def assign(batches):
        for batch in batches:
            prints = [fingerprint(text) for text in batch.column(at).to_pylist()]
            yield pa.record_batch(
                list(batch.columns) + [pa.array(prints, type=pa.int64())],
                names=batch.schema.names + [name],
            )

    return docs.mapInArrow(assign, schema)


def co_occurrence(prints):
    """(n, 64 x 64 counts of bits set together) over all fingerprints."""

    def count(batches):
        together, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), _CHUNK):
                part = np.ascontiguousarray(values[i:i + _CHUNK]).astype("<i8")
                bits = np.unpackbits(
                    part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
                ).astype(np.float32)
                together += np.rint(bits.T @ bits).astype(np.int64)
                n += len(part)
        cells = np.append(together.ravel(), n)
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = prints.select("fingerprint").mapInArrow(count, "cell long, n long")
    cells = dict(rows.groupBy("cell").agg(F.sum("n")).collect())
    flat = np.array([cells.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64)
    return cells.get(BITS * BITS, 0), flat.reshape(BITS, BITS)


def correlated_groups(n, together, parts):
    """Deal the bits into ``parts`` groups of near-equal size, correlated bits together."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free -= set(group)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits):
    """A signed long with these bits set."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def probe_masks(group, threshold):
    """Masks such that projections within ``threshold`` agree under at least one of them."""
    if threshold < 0:
        return []
    open_bits = itertools.combinations(group, threshold)
    return [mask_of(set(group) - set(gone)) for gone in open_bits]


def allocate(costs, total):
    """Thresholds with the least cost; ``costs[i][t]`` for t = -1, 0, 1, ...; they sum to ``total``."""
    best = {0: (0.0, ())}
    for cost in costs:
        longer = {}
        for spent, (value, chosen) in best.items():
            for t, more in cost.items():
                found = (value + more, chosen + (t,))
                if spent + t not in longer or found < longer[spent + t]:
                    longer[spent + t] = found
        best = longer
    return best[total]


def plan_probes(prints, distance=DISTANCE, choices=None):
    """(groups, thresholds) with the fewest estimated candidate pairs and probes."""
    n, together = co_occurrence(prints)
    p = np.diag(together) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) * (1 - p), 1e-3)
    odds = (1 - agree) / agree
    choices = choices or range(2, distance + 2)
    options = {m: correlated_groups(n, together, m) for m in choices}
    keys = [
        F.struct(
            F.lit(m).alias("m"), F.lit(i).alias("i"),
            F.col("fingerprint").bitwiseAND(F.lit(mask_of(group))).alias("key"),
        )
        for m, groups in options.items() for i, group in enumerate(groups)
    ]
    sizes = prints.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key")
    pairs = {
        (row["m"], row["i"]): row["pairs"]
        for row in sizes.agg(F.count("*").cast("double").alias("c")).groupBy("m", "i")
        .agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()
    }
    best = None
    for m, groups in options.items():
        costs = []
        for i, group in enumerate(groups):
            cost = {-1: 0.0}
            ways = 1.0
            for t in range(distance + 1):
                probes = len(probe_masks(group, t))
                # pairs equal in the group, times the odds of t further bits that differ
                ways += (odds[group].sum() ** t) / max(1, t) if t else 0.0
                cost[t] = pairs.get((m, i), 0.0) * ways + probes * float(n)
            costs.append(cost)
        value, thresholds = allocate(costs, distance - m + 1)
        if best is None or value < best[0]:
            best = (value, groups, thresholds)
    return best[1], best[2]


def linked_in_bucket(values, distance=DISTANCE, block=512):
    """Edges (smallest of the group, member) of the link groups among distinct fingerprints."""
    values = np.unique(np.asarray(values, dtype=np.int64))
    bits = values.view(np.uint64)
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, len(bits), block):
        apart = np.bitwise_count(bits[i:i + block, None] ^ bits[None, i:])
        for a, b in zip(*np.nonzero(apart <= distance)):
            if a < b:
                x, y = root(i + a), root(i + b)
                parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(values))], dtype=np.int64)
    moved = roots != np.arange(len(values))
    return values[roots[moved]], values[moved]


def _verify(distance):
    def verify(batches):
        for batch in batches:
            pairs = [
                linked_in_bucket(v, distance)
                for v in batch.column(0).to_numpy(zero_copy_only=False)
            ]
            a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return verify


def links(prints, distance=DISTANCE, bucket_limit=BUCKET_LIMIT, choices=None):
    """Edges (a, b) that connect all distinct fingerprints within ``distance``."""
    groups, thresholds = plan_probes(prints, distance, choices)
    masks = [m for g, t in zip(groups, thresholds) for m in probe_masks(g, t)]
    probes = prints.select(
        "fingerprint", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")
    )
    found = None
    while True:
        keyed = probes.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        # all probes of a bucket meet its size; single ones are gone
        met = stored(keyed.join(sizes, ["mask", "key"]))
        buckets = (
            met.where(F.col("n") <= bucket_limit)
            .groupBy("mask", "key")
            .agg(F.collect_list("fingerprint").alias("members"))
        )
        edges = buckets.select("members").mapInArrow(_verify(distance), "a long, b long")
        found = edges if found is None else found.union(edges)
        hot = met.where(F.col("n") > bucket_limit)
        split = {}
        for row in hot.select("mask").distinct().collect():  # masks are few: fixed by the plan
            split[row["mask"]] = finer_masks(row["mask"], distance)
        if not split:
            return found.distinct()
        wider = F.lit(None).cast("array<long>")
        for mask, finer in split.items():
            wider = F.when(
                F.col("mask") == mask, F.array(*[F.lit(m) for m in finer])
            ).otherwise(wider)
        # buckets of one coarse mask stay apart: the finer masks contain it
        probes = hot.select("fingerprint", F.explode(wider).alias("mask")).distinct()


def finer_masks(mask, distance):
    """Masks that add one of ``distance + 1`` shares of the open bits."""
    unsigned = mask % (1 << 64)
    open_bits = [b for b in range(BITS) if not unsigned >> b & 1]
    shares = [open_bits[i::distance + 1] for i in range(distance + 1)]
    closed = [b for b in range(BITS) if unsigned >> b & 1]
    return [mask_of(closed + share) for share in shares]


def components(edges):
    """(node, root): the smallest node of each component, by contraction of the links.

    In each round every node hooks on its smallest neighbour, chains are halved, and links are
    rewritten between the roots; links within a root vanish.
    """
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = stored(
            both.groupBy(F.col("a").alias("node")).agg(
                F.least(F.min("b"), F.min("a")).alias("up")
            )
        )
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = stored(parent.join(above, "up").select("node", F.col("top").alias("root")))
        if labels is None:
            labels = step
        else:
            hop = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stored(
                labels.join(hop, "root", "left")
                .select("node", F.coalesce("next", "root").alias("root"))
            )
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(
            edges.join(left, "a").join(right, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a <> b").distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def fingerprint_groups(printed, distance=DISTANCE, bucket_limit=BUCKET_LIMIT, choices=None):
    """(fingerprint, first_doc, root, component_id) for each distinct fingerprint."""
    unique = stored(
        printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"))
    )
    labels = components(links(unique, distance, bucket_limit, choices)).select(
        F.col("node").alias("fingerprint"), "root"
    )
    named = unique.join(labels, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    named = stored(named)
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return named.join(smallest, "root")


def near_duplicates(docs, distance=DISTANCE, bucket_limit=BUCKET_LIMIT, choices=None):
    """doc_id, fingerprint (hex) and component_id of every document."""
    printed = stored(with_fingerprints(documents_columns(docs)).select("doc_id", "fingerprint"))
    groups = fingerprint_groups(printed, distance, bucket_limit, choices)
    return printed.join(groups.select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs, distance=DISTANCE):
    """The rows of ``docs`` less near-duplicates: of each component the smallest doc_id stays."""
    name = unused(docs, "fingerprint")
    printed = stored(with_fingerprints(docs, name))
    groups = fingerprint_groups(
        printed.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("fingerprint")
        ),
        distance,
    )
    chosen = groups.groupBy("root").agg(
        F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "fingerprint")).alias("best")
    ).select(
        F.col("best.first_doc").alias("k_doc"), F.col("best.fingerprint").alias("k_print")
    )
    kept = printed.join(
        chosen,
        printed["doc_id"].cast("long").eqNullSafe(chosen["k_doc"])
        & (printed[name] == chosen["k_print"]),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", name]).select(*docs.columns)
