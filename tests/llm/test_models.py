"""The trained models against plain versions of the same formulas."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricemill.llm import jumphash, mixing, quadratic, simhash
from tests.llm.test_operators import plain_jump


@pytest.fixture
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_discriminant(x, labels, wanted):
    """Class densities with solve and slogdet instead of cached factors."""
    n = len(labels)
    means = [x[labels == c].mean(axis=0) for c in (0, 1)]
    spreads = [
        np.cov(x[labels == c], rowvar=False, bias=True) for c in (0, 1)
    ]
    shares = [(labels == c).sum() / n for c in (0, 1)]
    within = sum(s * v for s, v in zip(shares, spreads))
    scale = np.sqrt(np.maximum(np.diag(within), 1e-8))
    pooled = within / scale[:, None] / scale[None, :]
    logs = []
    for c in (0, 1):
        spread = spreads[c] / scale[:, None] / scale[None, :]
        spread = (1 - quadratic.TO_POOLED) * spread + quadratic.TO_POOLED * pooled
        k = len(scale)
        spread = (1 - quadratic.TO_SPHERE) * spread + (
            quadratic.TO_SPHERE * np.trace(spread) / k + 1e-6
        ) * np.eye(k)
        z = wanted / scale - means[c] / scale
        distance = np.einsum("ij,ij->i", z, np.linalg.solve(spread, z.T).T)
        logs.append(math.log(shares[c]) - 0.5 * np.linalg.slogdet(spread)[1] - 0.5 * distance)
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def test_quadratic_against_a_plain_discriminant(table):
    docs, labels = table("documents"), table("labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {
        r["label_doc"]: r["label"] for r in quadratic.training_labels(labels).collect()
        if r["label_doc"] in texts
    }
    x = {i: np.array(quadratic.statistics(t)) for i, t in texts.items()}
    ids = sorted(texts)
    want = plain_discriminant(
        np.array([x[i] for i in known]), np.array(list(known.values())), np.array([x[i] for i in ids])
    )
    got = {r["doc_id"]: r["score"] for r in quadratic.classify(docs, labels).collect()}
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-9


def plain_rates(tokens, p, shares, steps=mixing.STEPS, tolerance=mixing.TOLERANCE):
    """Projected gradient over all documents at once."""
    total = (tokens[:, None] * p).sum()
    goal = shares / shares.sum() * total
    expected = tokens @ p
    clean = mixing.DOMAINS.index("clean")
    goal = goal * max(1.0, expected[clean] / goal[clean])
    metric = np.linalg.pinv((p * tokens[:, None]).T @ p / total, rcond=1e-9, hermitian=True)
    moves, best, kept = [], np.inf, np.ones(len(p))
    for _ in range(steps + 1):
        rate = np.ones(len(p))
        for move in moves:
            rate = np.maximum(0, rate - p @ move)
        miss = ((tokens * rate) @ p - goal) / total
        if np.abs(miss).max() < best:
            best, kept = np.abs(miss).max(), rate
            if best <= tolerance:
                break
            moves.append(metric @ miss)
        else:
            moves[-1] = moves[-1] / 2
    return kept, goal


@pytest.mark.parametrize("clean", [0.5, 0.9, 0.99])
def test_rates_against_a_dense_descent(spark, clean):
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 600, p=[(1 - clean) / 2, clean, (1 - clean) / 2])
    p = rng.dirichlet([0.3] * 3, 600) * 0.2 + 0.8 * np.eye(3)[kind]
    tokens = rng.integers(1, 900, 600).astype(float)
    documents = spark.createDataFrame(
        [(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(tokens, p))],
        "doc_id long, n_tokens long, p array<double>",
    ).repartition(4)
    steps = mixing.fit_rates(documents)
    got = {r["doc_id"]: r["rate"] for r in mixing.rated(documents, steps).collect()}
    shares = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    want, goal = plain_rates(tokens, p, shares)
    assert np.abs(np.array([got[i] for i in range(600)]) - want).max() < 1e-7
    at = mixing.DOMAINS.index("clean")
    assert goal[at] >= (tokens @ p)[at] - 1e-6
    assert ((tokens * want) @ p)[at] >= 0.97 * (tokens @ p)[at]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    span = min(3, len(words))
    ones = [0] * 64
    total = 0
    for i in range(len(words) - span + 1):
        total += 1
        h = xxhash.xxh64(b" ".join(words[i:i + span]), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > total)


def test_fingerprints_against_a_loop(table):
    docs = table("documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}"


def test_shards_beside_a_column_of_that_name(spark, nasty, tmp_path):
    docs = nasty.withColumn("shard_key", F.lit("mine"))
    column = jumphash.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 13 and column != "shard"
    assert all(r["shard"] == "clash" and r["shard_key"] == "mine" for r in back)
    assert all(r[column] == plain_jump(r["doc_id"] or 0, 8) for r in back)
