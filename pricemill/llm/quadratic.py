"""A quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Per class, counts, sums and products are added
up in tasks; means and covariances follow on the driver from a few hundred numbers. Covariances
shrink towards the pooled one and its mean variance. The score is the logistic of the difference
of the two log densities, Mahalanobis distances by Cholesky factors that are computed once and
sent with the tasks. All labelled training rows are used.

Labels, language, source and doc_id are no inputs of a score. Defined cases: a null or empty text
has a vector like any other and is scored; label rows with null id or label are ignored, and of
several labels of one document the smallest counts; if a class has no training rows, all scores
are the smoothed share of the other; repeated rows are scored each on its own; empty tables give
no rows; other columns are ignored.
"""

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, stored

SYMBOLS = b"#*$%&|<>!"
PUNCTUATION = b".,;:?'\"()-"
FEATURES = 11
TO_POOLED = 0.1
TO_SPHERE = 0.05
THRESHOLD = 0.7
# Rates are drawn towards ordinary ones by so many words, as short texts vary more
PRIOR_WORDS = 20
HELD_OUT = (4, 2)


def _byte_class(members):
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_CLASSES = np.stack(
    [
        _byte_class(range(65, 91)), _byte_class(range(97, 123)), _byte_class(range(128, 256)),
        _byte_class(range(48, 58)), _byte_class(SYMBOLS), _byte_class(PUNCTUATION),
    ]
).astype(np.int64)


def statistics(text):
    """The transformed statistics of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    counts = _CLASSES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, other, digits, symbols, marks = (int(c) for c in counts)
    letters = upper + lower + other
    distinct = len(set(words))
    beside = sum(map(eq, words, words[1:]))
    windows = len(set(zip(words, words[1:], words[2:])))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    size = n + PRIOR_WORDS
    return (
        math.log(size),
        math.log((letters + 5 * PRIOR_WORDS) / size),
        math.log((distinct + PRIOR_WORDS) / size),
        math.sqrt(beside / size),
        math.sqrt(max(0, n - 2 - windows) / size),
        math.sqrt(upper / (letters + 5 * PRIOR_WORDS)),
        math.log1p(10 * symbols / size),
        math.sqrt(digits / (len(raw) + 6 * PRIOR_WORDS)),
        math.log((marks + 0.15 * PRIOR_WORDS) / size),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 2)),
        math.log(size / (len(lines) + 2)),
    )


def with_statistics(docs, columns=("doc_id",)):
    """The named columns of ``docs`` and ``x``, the vector of statistics."""
    inner = docs.select(*[F.col(c) for c in columns], F.col("text").cast("string").alias("_text"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]
        + ["`x` array<double>"]
    )

    def compute(batches):
        for batch in batches:
            flat = np.array(
                [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()],
                dtype=np.float64,
            ).ravel()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * FEATURES
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.record_batch(
                list(batch.columns[:-1]) + [x], names=list(columns) + ["x"]
            )

    return inner.mapInArrow(compute, schema)


def is_held_out(doc_id):
    modulus, remainder = HELD_OUT
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def training_labels(labels, column="quality"):
    """(label_doc, label): one label a document, none that is held out."""
    return (
        labels.select(
            F.col("doc_id").cast("long").alias("label_doc"),
            F.col(column).cast("int").alias("label"),
        )
        .where(F.col("label_doc").isNotNull() & F.col("label").isin(0, 1))
        .where(~is_held_out(F.col("label_doc")))
        .groupBy("label_doc").agg(F.min("label").alias("label"))
    )


def class_moments(vectors, labels):
    """{class: (n, sums, products)} of the labelled vectors."""
    rows = vectors.join(labels, vectors.doc_id == labels.label_doc).select("label", "x")

    def add(batches):
        totals = {}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            x = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                totals[c] = totals.get(c, 0) + x[label == c].T @ x[label == c]
        for c, total in totals.items():
            cells = total.ravel()
            yield pa.record_batch(
                [
                    pa.array(np.full(len(cells), c, dtype=np.int32)),
                    pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells),
                ],
                names=["label", "cell", "value"],
            )

    cells = rows.mapInArrow(add, "label int, cell int, value double")
    side = FEATURES + 1
    found = {}
    for label, cell, value in cells.groupBy("label", "cell").agg(F.sum("value")).collect():
        matrix = found.setdefault(label, np.zeros((side, side)))
        matrix[cell // side, cell % side] = value
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in found.items() if m[0, 0] > 0}


class Model:
    """Means and inverse Cholesky factors of both classes, in standardised statistics."""

    def __init__(self, moments, to_pooled=TO_POOLED, to_sphere=TO_SPHERE):
        self.counts = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
        self.classes = []
        if min(self.counts) == 0:
            return
        n = sum(self.counts)
        covariance = {}
        for c in (0, 1):
            count, sums, products = moments[c]
            mean = sums / count
            covariance[c] = (mean, products / count - np.outer(mean, mean))
        within = sum(self.counts[c] / n * covariance[c][1] for c in (0, 1))
        self.scale = np.sqrt(np.maximum(np.diag(within), 1e-8))
        pooled = within / np.outer(self.scale, self.scale)
        for c in (0, 1):
            mean, spread = covariance[c]
            spread = spread / np.outer(self.scale, self.scale)
            spread = (1 - to_pooled) * spread + to_pooled * pooled
            sphere = np.trace(spread) / FEATURES * np.eye(FEATURES)
            spread = (1 - to_sphere) * spread + to_sphere * sphere + 1e-6 * np.eye(FEATURES)
            factor = np.linalg.cholesky(spread)
            self.classes.append(
                (
                    mean / self.scale, np.linalg.inv(factor),
                    math.log(self.counts[c] / n) - np.log(np.diag(factor)).sum(),
                )
            )

    def scores(self, x):
        """The probability of class 1 for each row of statistics."""
        if not self.classes:
            share = (self.counts[1] + 1) / (sum(self.counts) + 2)
            return np.full(len(x), share)
        density = []
        for mean, inverse, constant in self.classes:
            z = (x / self.scale - mean) @ inverse.T
            density.append(constant - 0.5 * (z * z).sum(axis=1))
        apart = np.clip(density[1] - density[0], -500, 500)
        return 1 / (1 + np.exp(-apart))


def fit(vectors, labels, column="quality"):
    """The model of ``vectors`` (doc_id, x) and a table of labels."""
    return Model(class_moments(vectors, training_labels(labels, column)))


def classify(docs, labels, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted of every document."""
    vectors = stored(with_statistics(documents_columns(docs)))
    model = fit(vectors, labels)

    def score(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.record_batch(
                [batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"]
            )

    scored = vectors.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs, labels, threshold=THRESHOLD):
    """The rows of ``docs`` with a score of ``threshold`` or more; all columns are kept.

    The labelled rows are read once more for the fit, so that texts are not shuffled.
    """
    wanted = training_labels(labels)
    model = Model(
        class_moments(stored(with_statistics(documents_columns(docs))), wanted)
    )
    schema = docs.schema
    at = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if texts:
                x = np.array([statistics(t) for t in texts])
                yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(choose, schema)
