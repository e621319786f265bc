"""One query per operator, over whole tables, with SQL where SQL can express it."""

from pyspark.sql import functions as F

from pricemill.llm import (
    centroids, collocations, hostrules, jumphash, mixing, packing, quadratic, secrets, simhash, sql,
    tokencounts, topk, urlcascade, warc,
)
from pricemill.llm.common import table


def op1_top_k(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 50 == 0)


def op2_host_rules(spark, sf_dir):
    return hostrules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rejected", "kept",
    )


def op3_jump_hash(spark, sf_dir):
    return jumphash.shard_documents(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_url_cascade(spark, sf_dir):
    return urlcascade.filter_urls(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quadratic(spark, sf_dir):
    return quadratic.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_host_rules, op3_jump_hash, op4_secret_scan, op5_packing, op6_url_cascade,
        op7_simhash, op8_quadratic, op9_mixing, op10_token_counts, op11_collocations,
        op12_centroids, op13_warc, pipeline,
    )
}

ORACLES = {
    "op1_top_k": sql.TOP_K,
    "op2_host_rules": sql.host_rules(),
    "op3_jump_hash": sql.jump_hash(),
    "op6_url_cascade": sql.url_filter(),
    "op11_collocations": sql.COLLOCATIONS,
    "op12_centroids": sql.centroids(),
    "op13_warc": sql.WARC,
}
