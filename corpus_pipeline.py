"""Documents to packed training sequences, in stages that each read what the last wrote.

Every stage takes (spark, docs, sf_dir) and works on all of docs, which is what its
predecessor kept. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch
from statloom.llm.line_dedup import dedup_lines
from statloom.llm.near_copies import dedup_near_copies
from statloom.llm.packing import pack_documents
from statloom.llm.pii import replace_pii
from statloom.llm.quality import quality_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go: null, empty and short texts always, and
    what lies beyond its language's and source's limits. Null languages and sources are
    groups of their own; a value at its limit stays; rows that repeat stay or go together.
    Columns other than those of documents are left out. No rows, no result."""
    return quality_filter(docs.select(*COLUMNS))


def line_dedup(spark, docs, sf_dir):
    """Lines that ten documents or more have go from all of them. A text without lines left
    is empty, a null one becomes empty; empty lines stay. Rows that repeat a doc_id count as
    one document; a null one is an id like others. Other columns are left out."""
    return _as_documents(dedup_lines(docs, mode="frequent", min_docs=10, min_chars=1))


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: of 5-word shingles alike by 0.8, the
    one of the smallest doc_id. Null and empty texts are copies of each other and of
    nothing else; shorter texts are one shingle. Of rows that repeat a doc_id one stays; rows
    without stay only where their whole group has none. Other columns are left out."""
    return dedup_near_copies(docs, width=5, similarity=0.8).select(*COLUMNS)


def pii(spark, docs, sf_dir):
    """Personal data and secrets become surrogates, the same ones everywhere. Null and empty
    texts stay as they are; rows may repeat. Other columns are left out."""
    return _as_documents(replace_pii(docs, n_entities=None))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens and their places in sequences. Null and empty texts are
    the end token alone; rows that repeat give their pieces as often. No rows, no result."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii),
    ("best-fit packing", best_fit_packing),
]

#: The stages on shingle hashes, surrogates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents: each but the last is written to the shared folder and
    read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = scratch.put(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
