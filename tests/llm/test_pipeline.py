"""The pipeline's stages on awkward rows and on a whole small table."""

import corpus_pipeline
import numpy as np
import pytest

from pricemill.llm import nearcopies
from pricemill.llm.common import stored
from tests.llm.test_operators import plain_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into and comes out of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir))
        found[name] = (docs, after)
        docs = after
    return found


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == list(corpus_pipeline.COLUMNS)


def test_quality_drops_junk_and_keeps_good(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = {r["doc_id"] for r in stages["quality classifier"][1].collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(good & left) >= 0.97 * len(good) and len(bad & left) <= 0.05 * len(bad)


def test_copies_go(stages):
    before, after = (x.collect() for x in stages["near-duplicates"])
    texts = [r["text"] for r in after]
    assert len(texts) == len(set(texts)) and {r["text"] for r in after} <= {r["text"] for r in before}


def plain_similarity(a, b):
    def five(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = five(a), five(b)
    return len(a & b) / len(a | b)


def edited(words, edits, rng):
    """The words, ``edits`` of them replaced at random places."""
    words = list(words)
    for place in rng.choice(len(words), edits, replace=False):
        words[place] = f"edit{rng.integers(1 << 40)}"
    return words


@pytest.mark.parametrize("bucket_limit", [1024, 8])
def test_planted_edits_go(spark, sf_dir, bucket_limit):
    rng = np.random.default_rng(5)
    rows, near, far = [], set(), set()
    for i in range(400):
        words = [f"w{w}" for w in rng.integers(0, 5000, 300)]
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join(edited(words, i % 12, rng))))
        alike = plain_similarity(rows[-2][1], rows[-1][1]) >= 0.8
        (near if alike else far).add(10 * i + 1)
    base = [f"v{w}" for w in rng.integers(0, 5000, 200)]
    group = [(10_000 + i, " ".join(edited(base, 1, rng))) for i in range(60)]
    docs = spark.createDataFrame(rows + group, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars"
    )
    if bucket_limit == nearcopies.BUCKET_LIMIT:
        kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    else:
        kept = nearcopies.keep_one(docs, bucket_limit)
    left = {r["doc_id"] for r in kept.collect()}
    assert len(near) > 150 and len(far) > 50
    assert not near & left and far <= left
    assert {10 * i for i in range(400)} <= left
    assert {i for i, _ in group} & left == {10_000}


def test_secrets_are_marked(stages):
    before, after = (x.collect() for x in stages["secret scan"])
    assert len(before) == len(after)
    # the small table may hold none; test_redact covers the marking itself
    with_secrets = {r["doc_id"] for r in before if plain_spans(r["text"] or "")}
    changed = [r for r in after if "[SECRET]" in (r["text"] or "")]
    assert with_secrets <= {r["doc_id"] for r in changed}
    assert all(r["n_chars"] == len(r["text"]) for r in changed)


def test_clean_documents_stay_in_the_mix(spark, sf_dir, stages):
    before, after = ({r["doc_id"] for r in x.collect()} for x in stages["mixing"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    clean = {r["doc_id"] for r in labels.collect()} & before
    assert len(clean & after) >= 0.97 * len(clean)


def test_sequences_hold_all_tokens(stages):
    docs, packed = stages["packing"]
    rows = packed.collect()
    ends = sum(r["ids"][4 * i:4 * i + 4] == b"\x01\0\0\0" for r in rows
               for i in range(r["n_tokens"]))
    assert ends >= docs.count() and all(r["n_tokens"] <= 2048 for r in rows)


def test_awkward(spark, sf_dir, nasty, no_docs):
    for docs in (nasty, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        docs.count()
