"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from pricemill.llm import mixing, nearcopies, packing, quadratic, secrets
from pricemill.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Documents with weak evidence stay: a rejected document must look clearly like the bad class.
QUALITY_THRESHOLD = 0.5


def _documents(frame):
    """The columns of ``documents``, in order, whatever else a table carries."""
    return frame.select(*COLUMNS)


def quality(spark, docs, sf_dir):
    """Documents that the quadratic discriminant does not reject."""
    return quadratic.keep_good(
        _documents(docs), table(spark, sf_dir, "labels"), QUALITY_THRESHOLD
    )


def near_duplicates(spark, docs, sf_dir):
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8."""
    return nearcopies.keep_one(_documents(docs))


def secret_scan(spark, docs, sf_dir):
    """Every document, its secrets replaced by a mark; n_chars follows the new text."""
    cleaned = secrets.redact(_documents(docs))
    return cleaned.withColumn(
        "n_chars",
        F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(
            F.col("n_chars")
        ),
    ).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Each document as often as the fitted rate says."""
    return mixing.resample(_documents(docs), table(spark, sf_dir, "labels"))


def pack(spark, docs, sf_dir):
    """Sequences of at most 2048 ids with the pieces they hold."""
    return packing.sequences(_documents(docs))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

# Tokenization and the classifiers have no SQL form; tests/llm holds the stages against others.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; every stage before it is a stored table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
