"""Near copies by the Jaccard similarity of their shingles, as the pipeline's stage asks for.

A text is the set of its shingles of five words; two texts are near copies if their sets have a
Jaccard similarity of 0.8 or more. Candidates come from the SimHash of that set, searched by the
generalised pigeonhole of ``simhash`` at ``DISTANCE`` bits. At a similarity of 0.8 about ten of 64
bits differ, more than any pigeonhole over that many bits can search, so what fingerprints leave
apart is completed by min-hashes: texts that agree in all hashes of one band share a bucket. At a
similarity of exactly 0.8 a pair shares none of the ``BANDS`` buckets with a chance of 1 in 2800,
above it less. Every link of either kind is verified by the exact similarity.

All decisions are made on narrow rows: texts with equal sets are one node, a node is a number with
its sketch and the row it stands for. Texts move twice, for the nodes that have candidates and
for the rows that stay.

First pass: texts with one fingerprint are candidates of their first, and linked fingerprints of
each other by their first texts. Within a bucket of min-hashes only a forest of largest estimated similarity is emitted, verified by
the exact similarity of its two texts, and contracted. A bucket above ``bucket_limit`` is dealt
into blocks that share some pivots, so its rows stay in proportion. That links what is alike in
groups of any size. Second pass: where a bucket still holds several groups, its members come
together with their shingle sets, and the task compares all pairs across groups by exact
intersection counts; what leaves it is again a forest, at most one link a member. A member comes
along only if a pair across groups is possible by its sizes and sketches and in no earlier
bucket, and a block of the bucket's largest group meets only blocks of others. No pair of texts
is emitted to be looked at. Only a bucket with more than ``bucket_limit`` texts that are
all candidates and none alike is compared in pairs of blocks.

Words are those of ``simhash``. Defined cases: texts with equal sets are near copies, so texts
without words are one group; a text of one to four words is one shingle; a null doc_id stays only
if its group has no other; of rows with equal doc_id, repeated ones included, one stays, settled by
their places (the file's hash, then the row's number in it); empty tables give no rows; other columns are kept, whatever their names. ``docs`` is
a Parquet scan, whose rows have a stable place; any other frame is stored first.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pricemill.llm.common import stored, unused
from pricemill.llm.simhash import components, links, majority

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)
SEED = 42
DISTANCE = 3
BANDS, ROWS = 20, 5
BUCKET_LIMIT = 1024
# Estimates below this are no edge: three deviations of 100 hashes below the similarity
LEAST_ESTIMATE = 0.68
_CHUNK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1)).astype(np.uint64)


def shingles(text):
    """The distinct shingles of one text, as sorted unsigned 64-bit hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    span = min(SHINGLE_WORDS, len(words))
    return np.unique(np.array(
        [xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[span:])],
        dtype=np.uint64,
    ))


def min_hashes(hashes):
    """The smallest of the hashes under each of BANDS x ROWS multipliers; all ones if none."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    factor, shift = _FACTORS[0] * np.uint64(2) + np.uint64(1), _FACTORS[1]
    for i in range(0, len(hashes), _CHUNK):
        mixed = hashes[i:i + _CHUNK][None, :] * factor + shift
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return least


def similar(a, b):
    """Whether two sets of shingles are near copies; exact."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both * SIMILARITY[1] >= either * SIMILARITY[0]


def placed(docs, file, row):
    """``docs`` with the place of each row: a hash of its file and its number there."""

    def with_place(frame):
        return frame.select(
            "*", F.xxhash64("_metadata.file_path").alias(file),
            F.col("_metadata.row_index").alias(row),
        )

    try:
        return with_place(docs)
    except AnalysisException:  # not a scan of Parquet files
        return with_place(stored(docs))


def sketched(docs, file, row):
    """file, row, doc_id; of the shingles digest, SimHash, 16 bits of each min-hash, number."""

    def assign(batches):
        for batch in batches:
            digests, prints, sketches, sizes = [], [], [], []
            for text in batch.column(3).to_pylist():
                found = shingles(text)
                digests.append(xxhash.xxh128_digest(found.tobytes(), SEED))
                prints.append(majority(found))
                least = min_hashes(found)
                sketches.append((least & np.uint64(0xFFFF)).astype("<u2").tobytes())
                sizes.append(len(found))
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(prints, pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array(sizes, pa.int32())],
                names=["file", "row", "doc_id", "digest", "fingerprint", "sketch", "size"],
            )

    return docs.select(
        F.col(file).alias("file"), F.col(row).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(
        assign,
        "file long, row long, doc_id long, digest binary, fingerprint long, sketch binary, size int",
    )


def distinct_nodes(printed):
    """(node, null_doc, doc_id, file, row, fingerprint, sketch, size): each set, its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_doc"), "doc_id", "file", "row"))
    nodes = printed.groupBy("digest").agg(
        first.alias("first"),
        *[F.any_value(c).alias(c) for c in ("fingerprint", "sketch", "size")],
    )
    return stored(
        nodes.select(
            F.monotonically_increasing_id().alias("node"), "first.*", "fingerprint", "sketch", "size"
        )
    )


def fingerprint_edges(nodes, distance=DISTANCE):
    """Edges (a, b) of the nodes that fingerprints within ``distance`` link.

    A node is linked with the first of its own fingerprint, and the firsts of the fingerprints
    with each other; empty sets have no fingerprint to tell them by and no near copy.
    """
    printed = nodes.where("size > 0")
    firsts = stored(printed.groupBy("fingerprint").agg(F.min("node").alias("first")))
    same = printed.join(firsts, "fingerprint").where("node > first").select(
        F.col("first").alias("a"), F.col("node").alias("b")
    )
    left = firsts.select(F.col("fingerprint").alias("a"), F.col("first").alias("x"))
    right = firsts.select(F.col("fingerprint").alias("b"), F.col("first").alias("y"))
    linked = links(firsts.select("fingerprint"), distance).join(left, "a").join(right, "b")
    return same.unionAll(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def bucket_members(nodes):
    """(node, band, key) of every node in each of its buckets."""
    width = 2 * ROWS
    keys = [
        F.xxhash64(F.lit(i), F.substring("sketch", width * i + 1, width)) for i in range(BANDS)
    ]
    return nodes.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))


def alike(sketches, sizes, i, others):
    """Estimated similarity of i to ``others``, -1 where the sizes alone rule it out."""
    share = (sketches[others] == sketches[i]).mean(axis=1)
    low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    return np.where(low * SIMILARITY[1] >= high * SIMILARITY[0], share, -1.0)


def forest(sketches, sizes, least=LEAST_ESTIMATE):
    """Index pairs of the forest of largest estimated similarity, by Prim's method."""
    n = len(sketches)
    best, parent = np.full(n, -1.0), np.full(n, -1)
    left = np.ones(n, dtype=bool)
    edges, at, everyone = [], 0, np.arange(n)
    for _ in range(n - 1):
        left[at] = False
        share = alike(sketches, sizes, at, everyone)
        closer = left & (share > best)
        best[closer], parent[closer] = share[closer], at
        at = int(np.argmax(np.where(left, best, -2.0)))
        if best[at] >= least:
            edges.append((int(parent[at]), at))
    return edges


def possible(sketches, sizes, roots, band, least=LEAST_ESTIMATE):
    """Which members have a candidate of another root; pairs that share an earlier band are its."""
    n = len(sketches)
    found = np.zeros(n, dtype=bool)
    earlier = sketches[:, :band * ROWS].reshape(n, band, ROWS)
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(roots[i + 1:] != roots[i])
        others = others[alike(sketches, sizes, i, others) >= least]
        others = others[~(earlier[others] == earlier[i]).all(axis=2).any(axis=1)]
        found[others], found[i] = True, found[i] or len(others) > 0
    return found


def _members(batch):
    """Sorted members of each bucket in a batch: nodes, sketches, sizes, roots."""
    for members in batch.column("members").to_pylist():
        members = sorted(members, key=lambda m: m["node"])
        yield (
            np.array([m["node"] for m in members], dtype=np.int64),
            np.array([np.frombuffer(m["sketch"], dtype="<u2") for m in members]),
            np.array([m["size"] for m in members], dtype=np.int64),
            np.array([m.get("root", 0) for m in members], dtype=np.int64),
        )


def _forests(batches):
    for batch in batches:
        a, b = [], []
        for nodes, sketches, sizes, _ in _members(batch):
            for i, j in forest(sketches, sizes):
                a.append(min(nodes[i], nodes[j]))
                b.append(max(nodes[i], nodes[j]))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidate_edges(members, nodes, bucket_limit=BUCKET_LIMIT):
    """Edges (a, b) of a forest in every block of every bucket; ``members`` are (node, key, n).

    A bucket above ``bucket_limit`` has several blocks; about an eighth of a block are pivots,
    which go into all of them.
    """
    blocks = F.ceil(F.col("n") / bucket_limit).cast("int")
    chance = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 20))
    pivot = chance * (8 * F.col("n")) < (1 << 20) * bucket_limit
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = members.select(
        "node", "key",
        F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("block"),
    )
    together = dealt.join(nodes.select("node", "sketch", "size"), "node").groupBy(
        "key", "block"
    ).agg(F.collect_list(F.struct("node", "sketch", "size")).alias("members"))
    return together.select("members").mapInArrow(_forests, "a long, b long").distinct()


def _verified(batches):
    for batch in batches:
        known = {}  # the text of a hub comes with each of its edges

        def of(node, text):
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingles(text)
            return known[node]

        a, ta, b, tb = (batch.column(i).to_pylist() for i in range(4))
        keep = [similar(of(*x), of(*y)) for x, y in zip(zip(a, ta), zip(b, tb))]
        pairs = [(x, y) for x, y, k in zip(a, b, keep) if k]
        yield pa.record_batch(
            [pa.array([x for x, _ in pairs], pa.int64()),
             pa.array([y for _, y in pairs], pa.int64())], ["a", "b"],
        )


def verified_edges(edges, texts):
    """The edges whose ``texts`` (node, text) are near copies."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    met = edges.join(right, "b").join(left, "a").select("a", "ta", "b", "tb")
    return met.mapInArrow(_verified, "a long, b long")


def across_blocks(members, labels, bucket_limit=BUCKET_LIMIT):
    """(node, key, band, x, y, root): members of buckets of several roots, in pairs of blocks.

    Members of the bucket's largest root need not meet each other: their blocks meet those of all
    other members, and these each other, so copies are few unless a bucket holds many roots.
    """
    rooted = members.join(labels, "node", "left").select(
        "node", "key", "band", F.coalesce("root", "node").alias("root")
    )
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("key").agg(
        F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("roots")
    ).where("roots > 1").select("key", F.col("most.root").alias("main"), F.col("most.c").alias("mains"), "n")
    half = bucket_limit // 2

    def blocks(count):
        return F.greatest(F.ceil(count / half), F.lit(1)).cast("int")

    # blocks of the main root are 0, 1, ..., those of others -1, -2, ...
    met = rooted.join(several, "key").select(
        "node", "key", "band", "root", (F.col("root") == F.col("main")).alias("is_main"),
        blocks(F.col("mains")).alias("m"), blocks(F.col("n") - F.col("mains")).alias("o"),
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("m")).otherwise(F.col("o")))
    block = F.when(F.col("is_main"), own).otherwise(-1 - own).cast("int")
    others = F.sequence(-F.col("o"), F.lit(-1))
    alone = (F.col("m") == 1) & (F.col("o") == 1)  # the whole bucket fits one group
    partner = F.when(alone, F.array(F.lit(0))).when(F.col("is_main"), others).otherwise(
        F.concat(others, F.sequence(F.lit(0), F.col("m") - 1))
    )
    dealt = met.withColumn("block", F.when(alone, 0).otherwise(block)).withColumn(
        "other", F.explode(partner)
    )
    return dealt.select(
        "node", "key", "band", "root", F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
    )


def _possible(batches):
    for batch in batches:
        places = zip(*(batch.column(i).to_pylist() for i in range(4)))
        rows = []
        for (key, x, y, band), (nodes, sketches, sizes, roots) in zip(places, _members(batch)):
            for i in np.flatnonzero(possible(sketches, sizes, roots, band)):
                rows.append((key, x, y, int(nodes[i]), int(roots[i])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "x", "y", "node", "root"]
        )


def shared_counts(sets, width=1 << 13):
    """The sizes of all pairwise intersections, by products of the incidence of shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    column = np.full(len(often), -1)
    column[shared] = np.arange(len(shared))
    at = column[which]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    counts = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for first in range(0, len(shared), width):
        a, b = np.searchsorted(at, [first, first + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], at[a:b] - first] = 1
        counts += np.rint(part @ part.T).astype(np.int64)
    return counts


def linked_across(nodes, roots, sets):
    """Edges of a forest of the near copies among the groups ``roots`` of the nodes."""
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    either = sizes[:, None] + sizes[None, :] - both
    near = both * SIMILARITY[1] >= either * SIMILARITY[0]
    group = {r: r for r in set(roots)}

    def top(r):
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    edges = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            group[max(a, b)] = min(a, b)
            edges.append((nodes[i], nodes[j]))
    return edges


def _linked(batches):
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            found = linked_across(
                [m["node"] for m in members], [m["root"] for m in members],
                [np.frombuffer(m["shingles"], dtype="<u8") for m in members],
            )
            a += [x for x, _ in found]
            b += [y for _, y in found]
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _shingle_sets(batches):
    for batch in batches:
        sets = [shingles(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def links_across(members, labels, nodes, texts, bucket_limit=BUCKET_LIMIT):
    """Links between the groups that the first pass left apart, at most one a member and bucket."""
    dealt = across_blocks(members, labels, bucket_limit)
    narrow = dealt.join(nodes.select("node", "sketch", "size"), "node").groupBy(
        "key", "x", "y", "band"
    ).agg(
        F.collect_list(F.struct("node", "sketch", "size", "root")).alias("members")
    )
    open_ = stored(
        narrow.mapInArrow(_possible, "key long, x int, y int, node long, root long")
    )
    sets = texts.join(open_.select("node").distinct(), "node", "left_semi").select(
        "node", "text"
    ).mapInArrow(_shingle_sets, "node long, shingles binary")
    met = open_.join(sets, "node").groupBy("key", "x", "y").agg(
        F.collect_list(F.struct("node", "root", "shingles")).alias("members")
    )
    return met.select("members").mapInArrow(_linked, "a long, b long")


def near_copy_groups(nodes, fetch_texts, bucket_limit=BUCKET_LIMIT):
    """(node, root) of the nodes that have near copies; ``fetch_texts`` gets nodes' texts."""
    buckets = bucket_members(nodes)
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(buckets.join(sizes, "key").select("node", "key", "band", "n"))
    edges = stored(
        fingerprint_edges(nodes).unionAll(candidate_edges(members, nodes, bucket_limit)).distinct()
    )
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    large = members.where(F.col("n") > bucket_limit).select("node")
    texts = stored(fetch_texts(ends.unionAll(large).distinct()))
    linked = stored(verified_edges(edges, texts))
    labels = components(linked)
    # a bucket of two has no pair but the one that was verified
    more = stored(links_across(members.where("n > 2"), labels, nodes, texts, bucket_limit))
    return components(linked.unionAll(more))


def keep_one(docs, bucket_limit=BUCKET_LIMIT):
    """The rows of ``docs`` less near copies: of each group the smallest doc_id stays."""
    file, row = unused(docs, "file"), unused(docs, "row")
    located = placed(docs, file, row)
    nodes = distinct_nodes(sketched(located, file, row))
    texts = located.select(
        F.col(file).alias("file"), F.col(row).alias("row"), F.col("text").cast("string").alias("text")
    )

    def fetch_texts(wanted):
        places = nodes.join(wanted, "node", "left_semi").select("node", "file", "row")
        return texts.join(places.hint("merge"), ["file", "row"]).select("node", "text")

    labels = near_copy_groups(nodes, fetch_texts, bucket_limit)
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = named.groupBy("root").agg(
        F.min(F.struct("null_doc", "doc_id", "file", "row")).alias("best")
    ).select(F.col("best.file").alias(file), F.col("best.row").alias(row))
    return located.join(chosen.hint("merge"), [file, row], "left_semi").select(*docs.columns)
