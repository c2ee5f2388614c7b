"""A training corpus from raw documents: judge, deduplicate, redact, mix, encode.

Defined cases, stage by stage: null, empty and short texts fail the base test
of the quality rules and go there; a text of any length is treated whole; of
rows that repeat an id and a text, and of near copies, one stays, whatever the
ids are (null ids are told apart by their texts); a null source is a source of
its own in the mix; a null text, should one get that far, is encoded to null.
An empty table passes as an empty one.  Other columns of the documents pass
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelab.llm import mixing, pieces, rules, secrets, simhash
from tracelab.llm.common import stash, table

#: The vocabulary the last stage encodes with.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned decision list keep."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces of each document."""
    return pieces.encode(docs.select("doc_id", "source", "text"), pieces.Vocabulary.load(MODEL_PATH)).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The rules are learned and the fingerprints hashed by functions that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
