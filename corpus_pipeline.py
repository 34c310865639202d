"""Training corpus from documents: quality, near copies, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from depotlens.llm import jaccard_join, knn_quality, pattern_packing, pfair_mix, secret_scan
from depotlens.llm.common import release, shared_folder, sized_broadcast, table

NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark, docs, sf_dir):
    """Drop the documents that the quality classifier rejects."""
    model = knn_quality.fit(docs, table(spark, sf_dir, "labels"))
    return knn_quality.kept(docs, model)


def near_copies(spark, docs, sf_dir):
    """Keep the document with the smallest id of each group of near copies: five words a shingle, 80 percent."""
    return jaccard_join.one_of_each(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def secrets(spark, docs, sf_dir):
    """Replace secrets by a mark and count the characters anew."""
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    release(spark)
    found = secret_scan.scan(docs, model)
    return secret_scan.redact(found).withColumn("n_chars", F.when(
        F.size("secret_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark, docs, sf_dir):
    """Put the documents into the order of the mix; nothing is dropped."""
    place, at = sized_broadcast(pfair_mix.in_mix(docs)), docs["doc_id"]
    ordered = docs.join(place, at.eqNullSafe(place["_id"]), "left")
    return ordered.orderBy(place["_position"], at).select(*[docs[c] for c in docs.columns])


def packing(spark, docs, sf_dir):
    """Cut into token pieces and pack them into sequences that follow the mix.

    Files have no order, so the positions are computed again from ids and sources.
    """
    path = public_tokenizers.path(pattern_packing.TOKENIZER_FILE)
    cut, placed = pattern_packing.pieces(docs, path), sized_broadcast(pfair_mix.in_mix(docs))
    pieces = cut.join(placed, cut["doc_id"].eqNullSafe(F.col("_id")), "left").select(*cut.columns, "_position")
    return pattern_packing.packed(pieces, position="_position").drop("_position")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

# the classifier, the tokenizer and the packing plan cannot be put into SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a data directory, each one's result stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
