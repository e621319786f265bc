"""Phrases whose words occur together more often than apart, from sorted streams of counts.

Texts are cut into pieces and words (A-Z lower-cased; pieces end at ``. , ; : ! ?`` and line
breaks, words at spaces and tabs). Each word position gives one row, the phrase of up to
``MOST_WORDS`` words that begins there, added up per task. These rows are dealt into ranges of
keys and sorted once. In that order all phrases with the same first words lie together, so one pass over each range counts the
phrases of every length, and a run that a range boundary cuts is emitted in parts and added.

The frequent phrases are then read in two orders, by their words (prefix order) and by their
words from the last to the first (suffix order). In prefix order a phrase comes right behind its
first words, so a stack as deep as the longest phrase holds the counts of all left parts, and
each phrase sees the largest count of those that add one word at its end; suffix order gives the
right parts and those that add one word in front. No table of phrases is held in memory or sent
around. Ranges are cut anywhere, also inside one word's phrases: a phrase whose extensions go on
in later ranges is copied to them, at most ``MOST_WORDS`` rows a range.

A phrase inside a longer one by two words lies inside one longer by one that is at least as
frequent as the longest, so extensions by one word decide what is dropped.

Defined cases: a null or empty text has no words; a null language is ``und``; a null doc_id
counts like any other, and so does each of repeated rows; texts and words of any length are whole;
equal scores go by count, then by the phrase in byte order; empty tables give no rows; other
columns are ignored.
"""

import itertools
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.llm.common import shuffle_partitions, stored

MOST_WORDS = 4
LEAST_COUNT = 30
SCALE = 2_000_000
COVERED_PERCENT = 80
LARGEST = 2000
UNKNOWN_LANGUAGE = "und"
# Lower-case, every end of a piece a line feed, a tab a space
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n "
)
_WORDS_AT_ONCE = 3_000_000
_ROWS_AT_ONCE = 1 << 16
_BOUNDS_PER_RANGE = 100
_DOCUMENTS_PER_RANGE = 40
# Keys are words joined by \0; \0 and \1 inside words are escaped, which keeps their order
_JOIN = "\0"


def escaped(text):
    return text.replace("\1", "\1\2").replace("\0", "\1\1")


def unescaped(text):
    return text.replace("\1\1", "\0").replace("\1\2", "\1") if "\1" in text else text


def word_ids(text, ids):
    """The words of one text under ``ids``, 0 at every end of a piece."""
    plain = text.encode().translate(_PLAIN).replace(b"\n", b" \n ")
    return np.fromiter(map(ids.__getitem__, filter(None, plain.split(b" "))), dtype=np.int32)


def phrases_from(ids, most_words=MOST_WORDS):
    """(rows of word ids, counts): the distinct phrases that begin at a word, 0 behind a piece's end."""
    padded = np.zeros(len(ids) + most_words, dtype=np.int32)
    padded[:len(ids)] = ids
    begins = np.flatnonzero(ids)
    columns = [padded[begins]]
    for k in range(1, most_words):
        columns.append(np.where(columns[-1] > 0, padded[begins + k], 0))
    # two words to a key halves the sorts
    radix = int(ids.max(initial=0)) + 1
    keys = [
        a * np.int64(radix) + b
        for a, b in itertools.zip_longest(columns[::2], columns[1::2], fillvalue=0)
    ]
    del padded, begins, columns
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for i, key in enumerate(keys):
        keys[i] = key = key[order]
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(order)))
    found = [half for key in keys for half in np.divmod(key[starts], radix)]
    return found[:most_words], counts


class Pieces:
    """Words of many texts of one language, turned into counted phrases when asked."""

    def __init__(self, language):
        self.language = escaped(language)
        self.ids = defaultdict(itertools.count().__next__)
        self.ids[b"\n"]
        self.parts, self.size = [], 0

    def add(self, text):
        part = word_ids(text, self.ids)
        self.parts += [part, np.zeros(1, dtype=np.int32)]
        self.size += len(part) + 1

    def batches(self, most_words, bounds):
        """(part, key, c) in the order of the keys; the part counts the bounds up to the key."""
        # ids in the order of the words, so that keys leave almost sorted
        words = [None] + [escaped(w.decode()) for w in itertools.islice(self.ids, 1, None)]
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), dtype=np.int32)
        rank[order] = np.arange(1, len(words))
        names = pa.array([None] + [words[i] for i in order], pa.string())
        ids = rank[np.concatenate(self.parts)]
        self.ids, self.parts = None, None
        columns, counts = phrases_from(ids, most_words)
        language = pa.scalar(self.language, pa.string())
        for i in range(0, len(counts), _ROWS_AT_ONCE):
            parts = [names.take(pa.array(c[i:i + _ROWS_AT_ONCE])) for c in columns]
            keys = pc.binary_join_element_wise(language, *parts, _JOIN, null_handling="skip")
            yield pa.record_batch(
                [pa.array(parts_of(keys, bounds)), keys,
                 pa.array(counts[i:i + _ROWS_AT_ONCE], pa.int64())], ["part", "key", "c"],
            )


def parts_of(keys, bounds):
    """For sorted keys, the number of bounds up to each."""
    first = bisect_right(bounds, keys[0].as_py())
    last = bisect_right(bounds, keys[-1].as_py())
    cuts = [
        bisect_left(range(len(keys)), bound, key=lambda i: keys[i].as_py())
        for bound in bounds[first:last]
    ]
    lengths = np.diff([0, *cuts, len(keys)])
    return np.repeat(np.arange(first, last + 1, dtype=np.int32), lengths)


def phrase_rows(docs, most_words=MOST_WORDS, bounds=()):
    """(part, key, c): the phrase that begins at each word, added up over three million words."""

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for language, text in zip(*(column.to_pylist() for column in batch.columns)):
                if not text:
                    continue
                if language not in held:
                    held[language] = Pieces(language)
                before = held[language].size
                held[language].add(text)
                size += held[language].size - before
                if size >= _WORDS_AT_ONCE:
                    for pieces in held.values():
                        yield from pieces.batches(most_words, bounds)
                    held, size = {}, 0
        for pieces in held.values():
            yield from pieces.batches(most_words, bounds)

    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(count, "part int, key string, c long")


def _levels(keys, depth):
    """The parts of joined keys as columns, empty where a key is shorter, and the keys' lengths."""
    split = pc.split_pattern(keys, _JOIN)
    offsets = split.offsets.to_numpy()
    lengths = np.diff(offsets)
    columns = []
    for j in range(depth):
        at = pa.array(offsets[:-1] + j, mask=lengths <= j)
        columns.append(pc.fill_null(split.values.take(at), ""))
    return columns, lengths


class Runs:
    """Counts of the runs of equal first parts, over sorted keys that come in batches."""

    def __init__(self, depth, least):
        self.depth, self.least = depth, least
        self.open = [None] * depth  # [key, sum, whole] by level
        self.last = None

    def _flush(self, level):
        key, total, whole = self.open[level]
        self.open[level] = None
        return [(key, level, total)] if level == 0 or not whole or total >= self.least else []

    def feed(self, keys, counts):
        columns, lengths = _levels(keys, self.depth)
        new = np.zeros(len(keys), dtype=bool)
        for level, column in enumerate(columns):
            before = self.last is not None and self.last[level] == column[0].as_py()
            new[0] |= not before
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            stops = np.append(starts, len(keys))
            sums = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, np.int64)
            if self.open[level] is not None:
                self.open[level][1] += int(counts[:stops[0]].sum())
                if len(starts):
                    yield from self._flush(level)
            if not len(starts):
                continue
            there = lengths[starts] > level  # a shorter key is no phrase of this level
            keep = there & ((sums >= self.least) | (level == 0))
            first = self.last is None and level > 0
            keep[-1] = False
            if first:
                keep[0] = there[0] and len(starts) > 1  # the part of a run that a boundary cut
            chosen = np.flatnonzero(keep)
            at = pa.array(starts[chosen])
            names = pc.binary_join_element_wise(*[c.take(at) for c in columns[:level + 1]], _JOIN)
            yield from zip(names.to_pylist(), itertools.repeat(level), sums[chosen].tolist())
            if there[-1]:
                row = int(starts[-1])
                name = _JOIN.join(c[row].as_py() for c in columns[:level + 1])
                self.open[level] = [name, int(sums[-1]), not (first and len(starts) == 1)]
        self.last = [c[len(keys) - 1].as_py() for c in columns]

    def close(self):
        for level in range(self.depth):
            if self.open[level] is not None:
                self.open[level][2] = False  # it may go on behind the boundary
                yield from self._flush(level)


def phrase_bounds(docs, ranges, most_words=MOST_WORDS):
    """Keys that cut the phrases into ranges of about equal size.

    From some documents of the whole table; only the sizes of the ranges hang on which.
    """
    share = min(1.0, _DOCUMENTS_PER_RANGE * ranges / max(docs.count(), 1))
    rows = phrase_rows(docs.sample(share, seed=1), most_words)
    return range_bounds(stored(rows.select("key")), ranges)


def cut_evenly(keys, ranges):
    keys = sorted(keys)
    step = max(1, -(-len(keys) // ranges))
    return sorted(set(keys[step::step]))


def phrase_counts(docs, most_words=MOST_WORDS, least=LEAST_COUNT):
    """(key, words, f): every phrase with a count of ``least`` or more, and each language's words.

    Phrases go to their range in the one shuffle there is of them, and are sorted there.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    rows = phrase_rows(docs, most_words, phrase_bounds(docs, ranges, most_words))

    def stream(batches):
        runs = Runs(most_words + 1, least)

        def batch_of(found):
            keys, words, sums = zip(*found) if found else ((), (), ())
            return pa.record_batch(
                [pa.array(keys, pa.string()), pa.array(words, pa.int32()),
                 pa.array(sums, pa.int64())], ["key", "words", "f"],
            )

        for batch in batches:
            if batch.num_rows:
                yield batch_of(list(runs.feed(batch.column(0), batch.column(1).to_numpy())))
        yield batch_of(list(runs.close()))

    sorted_rows = rows.repartitionById(ranges, "part").sortWithinPartitions("key")
    return (
        sorted_rows.select("key", "c").mapInArrow(stream, "key string, words int, f long")
        .groupBy("key", "words").agg(F.sum("f").alias("f"))
        .where((F.col("f") >= least) | (F.col("words") == 0))
    )


def suffix_key(column):
    """The key with its words from the last to the first, behind the language."""
    parts = F.split(column, _JOIN)
    words = F.reverse(F.slice(parts, F.lit(2), F.size(parts)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), words), _JOIN)


def range_bounds(counts, ranges):
    """Keys that cut the counts into ranges of about equal size; at most 100 rows a range leave Spark."""
    n = counts.count()
    share = min(1.0, _BOUNDS_PER_RANGE * ranges / max(n, 1))
    found = [
        row[0] for row in counts.select(F.substring("key", 1, 256)).sample(share, seed=1)
        .limit(2 * _BOUNDS_PER_RANGE * ranges).collect()
    ]
    return cut_evenly(found, ranges)


def dealt(counts, bounds):
    """Each row in its range, and copies in the later ranges that hold its extensions."""

    def deal(batches):
        for batch in batches:
            source, part, copied = [], [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                own = bisect_right(bounds, key)
                last = bisect_left(bounds, key + "\1")
                for p in range(own, max(own, last) + 1):
                    source.append(i)
                    part.append(p)
                    copied.append(p > own)
            rows = batch.take(pa.array(source, pa.int64()))
            yield pa.record_batch(
                list(rows.columns) + [pa.array(part, pa.int32()), pa.array(copied, pa.bool_())],
                names=rows.schema.names + ["part", "copied"],
            )

    schema = "key string, other string, f long, part int, copied boolean"
    return counts.select("key", "other", "f").mapInArrow(deal, schema)


def walk(rows):
    """(other or key, counts of the first parts, largest count of an extension) in one sorted pass.

    ``rows`` are (key, other, f, copied) in order; what a copied row gives is its extension alone.
    """
    stack = []  # [key, other, f, copied, largest extension]

    def pop():
        key, other, f, copied, extension = stack.pop()
        return other, f, copied, [entry[2] for entry in stack], extension

    for key, other, f, copied in rows:
        while stack and not key.startswith(stack[-1][0] + _JOIN):
            yield pop()
        if stack:
            stack[-1][4] = max(stack[-1][4], f)
        stack.append([key, other, f, copied, 0])
    while stack:
        yield pop()


def stream_counts(counts, most_words=MOST_WORDS, ranges=None):
    """(other, f, n, part_1 ..., extension) of every phrase: one lockstep pass in the order of ``key``."""
    ranges = ranges or shuffle_partitions(counts.sparkSession)
    bounds = range_bounds(counts, ranges)
    names = ["other", "f", "n"] + [f"part_{k}" for k in range(1, most_words)] + ["extension"]
    schema = ", ".join(["other string"] + [f"{name} long" for name in names[1:]])

    def merged(batches):
        def rows():
            part = None
            for batch in batches:
                for p, key, other, f, copied in zip(*(c.to_pylist() for c in batch.columns)):
                    if p != part:
                        yield None
                        part = p
                    yield key, other, f, copied
            yield None

        def batch_of(found):
            arrays = [pa.array(c, pa.int64()) for c in list(zip(*found))[1:]] if found else [
                pa.array([], pa.int64())] * (len(names) - 1)
            return pa.record_batch([pa.array([r[0] for r in found], pa.string())] + arrays, names)

        found, rest = [], rows()
        next(rest, None)
        for _, part in itertools.groupby(_numbered(rest), key=lambda x: x[0]):
            for other, f, copied, before, extension in walk(row for _, row in part):
                if copied:
                    if extension:
                        found.append([other] + [None] * (len(names) - 2) + [extension])
                elif before:  # a language by itself is no phrase
                    shorter = before[1:] + [None] * (most_words - len(before))
                    found.append([other, f, before[0], *shorter, extension])
                if len(found) >= _ROWS_AT_ONCE:
                    yield batch_of(found)
                    found = []
        yield batch_of(found)

    return (
        dealt(counts, bounds).select("part", "key", "other", "f", "copied")
        .repartitionById(ranges, "part").sortWithinPartitions("part", "key")
        .mapInArrow(merged, schema)
    )


def _numbered(rows):
    """(number of the range, row); None ends a range."""
    part = 0
    for row in rows:
        if row is None:
            part += 1
        else:
            yield part, row


def scored(streams, most_words=MOST_WORDS, least=LEAST_COUNT, scale=SCALE,
           covered_percent=COVERED_PERCENT):
    """Candidates with a, l, r, n and score: the lowest cut of each, less those a longer one covers.

    ``streams`` has the rows of both orders: left parts as ``l_k``, right parts as ``r_k``.
    """
    parts = [f"{side}_{k}" for side in "lr" for k in range(1, most_words)]
    joined = streams.groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("f", "n", "extension", *parts)]
    )
    words = F.size(F.split("key", _JOIN)) - 1
    # 38 digits: the product passes 64 bits, the division is exact
    product = F.lit(scale).cast("decimal(10,0)") * F.col("f").cast("decimal(19,0)")

    def cut(k, size):
        left, right = F.col(f"l_{k}"), F.col(f"r_{size - k}")
        both = left.cast("decimal(19,0)") + right.cast("decimal(19,0)")
        share = F.call_function("div", product, both)
        return F.struct(share.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    best = F.lit(None)
    for size in range(2, most_words + 1):
        cuts = F.array(*[cut(k, size) for k in range(1, size)])
        best = F.when(F.col("words") == size, F.array_min(cuts)).otherwise(best)
    return (
        joined.withColumn("words", words)
        .where(
            (F.col("words") >= 2) & (F.col("f") >= least)
            & (100 * F.col("extension") < covered_percent * F.col("f"))
        )
        .withColumn("best", best)
        .select("key", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    )


def readable(found):
    """lang and phrase in place of the key."""

    def split(batches):
        for batch in batches:
            keys = [key.split(_JOIN, 1) for key in batch.column(0).to_pylist()]
            languages = pa.array([unescaped(k) for k, _ in keys], pa.string())
            phrases = [" ".join(unescaped(w) for w in p.split(_JOIN)) for _, p in keys]
            yield pa.record_batch(
                [languages, pa.array(phrases, pa.string()), *batch.columns[1:]],
                names=["lang", "phrase", *batch.schema.names[1:]],
            )

    schema = "lang string, phrase string, a long, l long, r long, n long, score long"
    return found.select("key", "a", "l", "r", "n", "score").mapInArrow(split, schema)


def candidates(docs, most_words=MOST_WORDS, least=LEAST_COUNT, scale=SCALE,
               covered_percent=COVERED_PERCENT):
    """lang, phrase, a, l, r, n, score of every phrase that is frequent and not covered."""
    counts = stored(phrase_counts(docs, most_words, least))
    turned = suffix_key(F.col("key"))
    numbers = [f"part_{k}" for k in range(1, most_words)]
    by_prefix = stream_counts(counts.select("key", F.col("key").alias("other"), "f"), most_words)
    by_suffix = stream_counts(
        counts.select(turned.alias("key"), F.col("key").alias("other"), "f"), most_words
    )
    none = F.lit(None).cast("long")
    streams = [
        stream.select(
            F.col("other").alias("key"), "f", "n", "extension",
            *[
                (F.col(name) if side == own else none).alias(f"{side}_{name[5:]}")
                for side in "lr" for name in numbers
            ],
        )
        for own, stream in (("l", by_prefix), ("r", by_suffix))
    ]
    return readable(
        scored(streams[0].unionAll(streams[1]), most_words, least, scale, covered_percent)
    )


def collocations(docs, largest=LARGEST, **limits):
    """The best ``largest`` phrases of each language, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        candidates(docs, **limits).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= largest)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
