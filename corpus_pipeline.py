"""A training corpus in five stages: toxic documents go, near copies go, repeated passages go, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers

from tessella.llm import mixing, ngram_join, piecewise, substring_dedup, toxicity
from tessella.llm.exchange import fresh_path


def without_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Words of a shingle and percent of Jaccard similarity from which texts are near copies.
SHINGLE, NEAR = 5, 80


def without_near_copies(spark, docs, sf_dir):
    return ngram_join.keep_one(docs, SHINGLE, NEAR)


def without_repeated_passages(spark, docs, sf_dir):
    return substring_dedup.dedup_documents(docs)


def mixed(spark, docs, sf_dir):
    return mixing.repeat_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoded(spark, docs, sf_dir):
    return piecewise.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("piecewise", encoded),
]

#: Training a classifier and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows: doc_id, n_ids, ids, round_trip for each copy of each kept document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
