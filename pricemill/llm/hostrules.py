"""Quality rules on documents and on the hosts they come from.

Each document gets counts from its whole text and a base verdict. Failures are then summed by
host for every rule, each host's rate is shrunk towards a beta prior fitted to all hosts (method
of moments), and a host whose shrunken rate stays above the limit even after ``deviations``
posterior deviations are taken off loses all its documents.

Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``. Defined cases: a null or
empty text has no words and so fails; a null host is no host and gets no verdict; with no hosts
or no spread between them the prior is the pooled rate with weight one. Repeated rows are
judged each on its own. Empty tables give no rows.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, stored

# Fixed values of the base rules
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"

RULES = ("short", "repeated", "symbols", "dup_lines")

_COUNTS = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, n_lines long"
)


def text_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    blanks = sum(raw.count(c) for c in b" \t\n\v\f\r")
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated, end = 0, 0
    found = Counter(windows)
    if len(found) < len(windows):
        for i, window in enumerate(windows):
            if found[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated,
        len(lines),
    )


def _count_batches(batches):
    for batch in batches:
        counts = [text_counts(text) for text in batch.column("text").to_pylist()]
        columns = list(zip(*counts)) if counts else [()] * 6
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("host")]
            + [pa.array(column, type=pa.int64()) for column in columns],
            names=[c.split()[0] for c in _COUNTS.split(", ")],
        )


def document_counts(docs, host_column="source"):
    """Counts per document and which rules it fails; one pass over the texts."""
    host = F.col(host_column).cast("string").alias("host")
    counted = documents_columns(docs, host).mapInArrow(_count_batches, _COUNTS)
    short = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return counted.select(
        "*",
        short.alias("short"),
        repeated.alias("repeated"),
        (10 * F.col("n_symbols") > F.col("n_words")).alias("symbols"),
        (2 * F.col("n_dup_lines") > F.col("n_lines")).alias("dup_lines"),
        (short | repeated).alias("base_failed"),
    )


def host_rates(counted, rules=RULES):
    """Per host: documents and failures of each rule."""
    return counted.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(rule).cast("long")).alias(rule) for rule in rules],
    )


def beta_priors(rates, rules=RULES):
    """{rule: (alpha, beta)} by moments over all hosts: one aggregated row reaches the driver."""
    parts = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("inv")]
    for rule in rules:
        rate = F.col(rule) / F.col("n")
        parts += [
            F.sum(rule).alias(rule), F.sum(rate).alias(f"{rule}_s"),
            F.sum(rate * rate).alias(f"{rule}_ss"),
        ]
    row = rates.agg(*parts).first()
    return {
        rule: beta_prior(
            row["hosts"], row["n"], row["inv"], row[rule], row[f"{rule}_s"], row[f"{rule}_ss"]
        )
        for rule in rules
    }


def beta_prior(hosts, n, inverse, failures, rate_sum, rate_squares):
    """Moments of the rates, less the binomial noise that small hosts add."""
    if not hosts:
        return 0.5, 0.5
    pooled = failures / n
    if hosts < 2 or not 0 < pooled < 1:
        return pooled, 1 - pooled
    mean = rate_sum / hosts
    spread = (rate_squares - hosts * mean * mean) / (hosts - 1)
    noise = pooled * (1 - pooled) * inverse / hosts
    limit = mean * (1 - mean)
    between = min(max(spread - noise, 0.0), limit * 0.999)
    if between <= limit * 1e-6:
        between = limit * 1e-6
    weight = max(limit / between - 1, 1e-3)
    return mean * weight, (1 - mean) * weight


def host_verdicts(rates, priors, limit=0.5, deviations=2.0):
    """Hosts with ``host_rejected``: some rule's shrunken rate is surely above the limit."""
    rejected = F.lit(False)
    shrunk = []
    for rule, (alpha, beta) in priors.items():
        total = F.col("n") + (alpha + beta)
        rate = (F.col(rule) + alpha) / total
        deviation = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (total + 1))
        rejected = rejected | (rate - deviations * deviation > limit)
        shrunk.append(rate.alias(f"{rule}_rate"))
    return rates.select("host", *shrunk, rejected.alias("host_rejected"))


def judge(docs, host_column="source", limit=0.5, deviations=2.0, salts=32):
    """Counts, base verdict and final verdict ``kept`` for every document.

    Verdicts meet documents on (host, salt), so that a host with a third of all documents is
    spread over ``salts`` tasks.
    """
    counted = stored(document_counts(docs, host_column))
    rates = host_rates(counted)
    verdicts = host_verdicts(rates, beta_priors(rates), limit, deviations)
    salted = verdicts.select(
        F.col("host").alias("v_host"), "host_rejected",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("v_salt"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")
    left = counted.withColumn("salt", salt)
    joined = left.join(
        salted, (left.host == salted.v_host) & (left.salt == salted.v_salt), "left"
    )
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select(
        *[name for name in counted.columns if name != "n_lines"],
        rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )
