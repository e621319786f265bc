"""Mixing to target weights with soft domains.

A classifier trained on the labelled table gives every document a posterior over the domains junk,
clean and toxic. Its features are hashed distinct words and a few levels of repetition and form.
Over all labelled documents, each domain's ``FEATURES`` buckets are chosen that differ most, in
deviations, from their expected number of documents. A logistic regression on these is fitted on
``SAMPLE`` labelled documents at most, those of the smallest hashes.

Then document rates are fitted: nonnegative numbers such that the expected tokens of each domain, summed over documents by posterior and rate,
match the targets. The fit is projected gradient descent on the squared misses, from rates of one,
in the metric of the token-weighted posteriors; a step that does not lessen the misses is halved.
Each step adds up the misses of the domains in one pass over (tokens, posteriors); a document's
rate follows from its posteriors and the steps so far, so there is no state to lose.

Tokens are words. Defined cases: a null or empty text has no tokens and the posterior of the
classifier's constant; label rows with null values are ignored, and of several labels of a
document toxic comes before junk before clean; a domain without labelled rows has posterior zero;
the target of a domain without expected tokens is dealt to the others in proportion; without
labels all documents are clean; repeated rows are rated each on its own; empty tables give no
rows; other columns are ignored.
"""

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, stored

DOMAINS = ("junk", "clean", "toxic")
TARGETS = {"junk": 0.02, "clean": 0.96, "toxic": 0.02}
BUCKETS = 1 << 16
FEATURES = 300
SAMPLE = 16384
ROUNDS = 200
RIDGE = 1e-5
STEPS = 30
TOLERANCE = 1e-4


def word_buckets(text):
    """(number of words, packed distinct buckets) of one text."""
    words = (text or "").encode().split()
    n, distinct = len(words), set(words)
    features = [zlib.crc32(w) for w in distinct]
    if n:
        levels = (
            8 * len(distinct) // n,
            8 * sum(map(eq, words, words[1:])) // n,
            8 * sum(map(bytes.isupper, words)) // n,
            8 * sum(not w.isalnum() and w.isascii() for w in words) // n,
        )
        features += [zlib.crc32(b" %d %d" % level) for level in enumerate(levels)]
    found = sorted({f & (BUCKETS - 1) for f in features})
    return n, np.array(found, dtype="<u2").tobytes()


def hashed_documents(docs):
    """doc_id, n_tokens and the packed buckets; one pass over the texts."""

    def read(batches):
        for batch in batches:
            found = [word_buckets(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], type=pa.int64()),
                    pa.array([b for _, b in found], type=pa.binary()),
                ],
                names=["doc_id", "n_tokens", "buckets"],
            )

    return documents_columns(docs).mapInArrow(read, "doc_id long, n_tokens long, buckets binary")


def domain_labels(labels):
    """(label_doc, domain): toxic before junk before clean."""
    return (
        labels.select(
            F.col("doc_id").cast("long").alias("label_doc"), "quality", "toxic"
        )
        .dropna()
        .groupBy("label_doc")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select(
            "label_doc",
            F.when(F.col("toxic") == 1, DOMAINS.index("toxic"))
            .when(F.col("quality") == 0, DOMAINS.index("junk"))
            .otherwise(DOMAINS.index("clean")).alias("domain"),
        )
    )


def labelled(hashed, labels):
    """(label_doc, domain, buckets) of the labelled documents."""
    wanted = domain_labels(labels)
    return hashed.join(wanted, hashed.doc_id == wanted.label_doc).select(
        "label_doc", "domain", "buckets"
    )


def bucket_counts(rows):
    """domains x (BUCKETS + 1) numbers of documents with each bucket; the last column is of all."""

    def add(batches):
        totals = np.zeros((len(DOMAINS), BUCKETS + 1))
        for batch in batches:
            for domain, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[domain][np.frombuffer(data, dtype="<u2")] += 1
                totals[domain][BUCKETS] += 1
        cells = totals.ravel()
        used = np.nonzero(cells)[0]
        yield pa.record_batch(
            [pa.array(used.astype(np.int32)), pa.array(cells[used])], names=["cell", "n"]
        )

    sums = (
        rows.select("domain", "buckets").mapInArrow(add, "cell int, n double")
        .groupBy("cell").agg(F.sum("n")).collect()
    )
    totals = np.zeros(len(DOMAINS) * (BUCKETS + 1))
    for cell, n in sums:
        totals[cell] = n
    return totals.reshape(len(DOMAINS), BUCKETS + 1)


def telling_buckets(counts):
    """The buckets that differ most between domains, at most FEATURES for each."""
    documents, found = counts[:, BUCKETS], counts[:, :BUCKETS]
    expected = np.outer(documents, found.sum(axis=0) / max(1.0, documents.sum()))
    deviations = np.abs(found - expected) / np.sqrt(expected + 2)
    return np.unique(np.argsort(-deviations, axis=1, kind="stable")[:, :FEATURES])


def design(packed, chosen):
    """Presence of the chosen buckets in each document, and a constant."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(packed), len(chosen) + 1), dtype=np.float32)
    x[:, -1] = 1
    for row, data in zip(x, packed):
        at = place[np.frombuffer(data, dtype="<u2")]
        row[at[at >= 0]] = 1
    return x


def chosen_places(rows, chosen):
    """(label_doc, domain, places): which of the chosen buckets a document has, two bytes each."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def find(batches):
        for batch in batches:
            at = [place[np.frombuffer(b, dtype="<u2")] for b in batch.column(2).to_pylist()]
            found = [a[a >= 0].astype("<u2").tobytes() for a in at]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, type=pa.binary())],
                names=["label_doc", "domain", "places"],
            )

    return rows.select("label_doc", "domain", "buckets").mapInArrow(
        find, "label_doc long, domain int, places binary"
    )


def logistic(x, domain, present, rounds=ROUNDS, ridge=RIDGE):
    """Multinomial logistic weights by accelerated gradient descent; absent domains get none."""
    weights = ahead = np.zeros((x.shape[1], len(DOMAINS)), dtype=np.float32)
    truth = np.eye(len(DOMAINS), dtype=np.float32)[domain]
    step = np.float32(2) / max(np.linalg.eigvalsh(x.T @ x / len(x)).max(), 1e-6)
    t = 1.0
    for _ in range(rounds):
        miss = softmax(x @ ahead, present) - truth
        following = ahead - step * (x.T @ miss / len(x) + np.float32(ridge) * ahead)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = following + np.float32((t - 1) / later) * (following - weights)
        weights, t = following, later
    return weights


def softmax(values, present):
    values = np.where(present, values, -np.inf)
    values = np.exp(values - values.max(axis=1, keepdims=True))
    return values / values.sum(axis=1, keepdims=True)


def train(hashed, labels):
    """(chosen buckets, weights, domains with labels)."""
    rows = stored(labelled(hashed, labels))
    counts = bucket_counts(rows)
    present = counts[:, BUCKETS] > 0
    if not present.any():
        clean = np.arange(len(DOMAINS)) == DOMAINS.index("clean")
        return np.zeros(0, dtype=np.int64), np.zeros((1, len(DOMAINS))), clean
    chosen = telling_buckets(counts)
    # at most SAMPLE rows of len(DOMAINS) * FEATURES places reach the driver, however long the texts
    sample = (
        chosen_places(rows, chosen)
        .orderBy(F.xxhash64("label_doc"), "label_doc", "places").limit(SAMPLE).collect()
    )
    x = design([row["places"] for row in sample], np.arange(len(chosen)))
    return chosen, logistic(x, [row["domain"] for row in sample], present), present


def posteriors(packed, chosen, weights, present):
    """Domain posteriors of documents, by rows."""
    return softmax(design(packed, chosen) @ weights, present)


def with_posteriors(hashed, model):
    """doc_id, n_tokens and p, the posteriors."""

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p = posteriors(part.column(2).to_pylist(), *model).tolist()
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(p, type=pa.list_(pa.float64()))],
                    names=["doc_id", "n_tokens", "p"],
                )

    return hashed.mapInArrow(predict, "doc_id long, n_tokens long, p array<double>")


def rates_after(p, steps):
    """Rates of documents with posteriors ``p`` after the steps, starting from one."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _matrix(column):
    return column.flatten().to_numpy().reshape(-1, len(DOMAINS))


def _sums(frame, function, size):
    """Sum of ``function(tokens, posteriors)``, an array of ``size``, over all documents."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                tokens = batch.column(0).to_numpy().astype(np.float64)
                total += function(tokens, _matrix(batch.column(1)))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], ["cell", "v"])

    cells = frame.select("n_tokens", "p").mapInArrow(add, "cell long, v double")
    found = dict(cells.groupBy("cell").agg(F.sum("v")).collect())
    return np.array([found.get(i, 0.0) for i in range(size)])


def fit_rates(documents, targets=None, steps=STEPS, tolerance=TOLERANCE):
    """Steps of the projected gradient descent over ``documents`` (n_tokens, p).

    The best steps whose totals were computed. Where clean documents hold more than their share
    already, the goal grows with them, so that none of them has to go.
    """
    k = len(DOMAINS)
    share = np.array([(targets or TARGETS)[d] for d in DOMAINS], dtype=np.float64)

    def start(tokens, p):
        return np.concatenate([tokens @ p, ((p * tokens[:, None]).T @ p).ravel()])

    first = _sums(documents, start, k + k * k)
    expected, products = first[:k], first[k:].reshape(k, k)
    total = expected.sum()
    share = np.where(expected > 1e-9 * max(total, 1.0), share, 0.0)
    if total == 0 or share.sum() == 0:
        return []
    goal = share / share.sum() * total
    clean = DOMAINS.index("clean")
    if 0 < goal[clean] < expected[clean]:
        goal = goal * (expected[clean] / goal[clean])
    metric = np.linalg.pinv(products / total, rcond=1e-9, hermitian=True)
    taken, kept, best, miss = [], [], np.inf, (expected - goal) / total
    for _ in range(steps):
        if np.abs(miss).max() >= best:
            taken[-1] = taken[-1] / 2
        else:
            kept, best = list(taken), np.abs(miss).max()
            if best <= tolerance:
                break
            taken.append(metric @ miss)
        tried = list(taken)

        def achieved(tokens, p):
            return (tokens * rates_after(p, tried)) @ p

        miss = (_sums(documents, achieved, k) - goal) / total
    return list(taken) if np.abs(miss).max() < best else kept


def rated(documents, steps):
    """doc_id, n_tokens, the posterior of each domain and rate."""
    names = ["doc_id", "n_tokens"] + [f"p_{d}" for d in DOMAINS] + ["rate"]

    def rate(batches):
        for batch in batches:
            p = _matrix(batch.column(2))
            found = rates_after(p, steps)
            columns = [pa.array(np.ascontiguousarray(c)) for c in (*p.T, found)]
            yield pa.record_batch([batch.column(0), batch.column(1)] + columns, names=names)

    kinds = ["long", "long"] + ["double"] * (len(DOMAINS) + 1)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    return documents.select("doc_id", "n_tokens", "p").mapInArrow(rate, schema)


def mix(docs, labels, targets=None):
    """doc_id, n_tokens, posteriors and rate of every document."""
    hashed = stored(hashed_documents(docs))
    documents = stored(with_posteriors(hashed, train(hashed, labels)))
    return rated(documents, fit_rates(documents, targets))


def resample(docs, labels, targets=None):
    """The rows of ``docs``, each as often as its rate says.

    The fraction of a rate is settled by a hash of the row, so the same rows come out each time.
    """
    hashed = stored(hashed_documents(docs))
    model = train(hashed, labels)
    documents = stored(with_posteriors(hashed, model))
    steps = fit_rates(documents, targets)
    at = (docs.columns.index("doc_id"), docs.columns.index("text"))

    def repeat(batches):
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in at)
            if not ids:
                continue
            p = posteriors([word_buckets(t)[1] for t in texts], *model)
            rate = rates_after(p, steps)
            chance = np.array([zlib.crc32(f"mix{i}".encode()) / 2**32 for i in ids])
            times = np.floor(rate + chance).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(len(ids)), times)))

    return docs.mapInArrow(repeat, docs.schema)
