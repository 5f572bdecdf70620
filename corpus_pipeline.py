"""A corpus pipeline: five stages, each a corpus operator over documents.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents; other columns that documents may have are left behind.

Odd rows, stage by stage: an empty table gives an empty one. A null, empty or
blank text is clean; all such texts are one group of near copies; it has no
entities, no words to mix (it is taken as often as its hash says) and no tokens.
Rows without doc_id are in groups like any other, and one stays of a group that
has no doc_id at all. Equal rows under one doc_id are one row from the second
stage on; another text under that doc_id stays. Texts may be of any length:
workers hold slices of a few megabytes, or one text. Folders of the stages lie
under the shared folder and are left for a rerun to look at.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from listingflow.functions.lineage import shared_folder
from listingflow.llm import bpe, mixing, pii, simhash, toxicity
from listingflow.llm.queries import THRESHOLD, held_out
from listingflow.llm.text import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words a shingle, most bits between fingerprints, least Jaccard similarity.
SIMILAR = 5, 11, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; trained on this stage's docs."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels), THRESHOLD).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of similar texts."""
    return simhash.keep_similar(docs, *SIMILAR).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    out = pii.replaced(docs)
    return out.selectExpr("doc_id", "text", "lang", "source", "if(n_entities > 0, cast(length(text) as bigint), n_chars) as n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all."""
    return mixing.take(docs).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("pii surrogates", pii_stage),
    ("source mixing", mixing_stage),
    ("bpe encoding", bpe_stage),
]
#: A trained model, SimHash and BPE are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between them go to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
