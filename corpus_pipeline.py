"""A training corpus from raw documents, in five stages.

Every stage takes the documents its predecessor kept and gives documents again;
the last gives their tokens (ids), counts and digests. Toxic documents go; one document
of each near-duplicate group stays; secrets are replaced in the texts; documents
are repeated or left out so that the domains meet their target weights; all
texts that are left are encoded and decoded again.

Defined cases: a null or empty text is scored like any other, has fingerprint zero
(one of all such documents stays), holds no secret, no tokens and no ids; rows
without an id are kept but where a near copy has one; repeated rows are copies of
each other; an empty table gives an empty result; extra columns are carried through
to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolake.llm import bpe, mixing, secrets, simhash, toxicity
from hypolake.llm.common import table, written
from hypolake.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, vocabulary_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_domains),
    ("bpe_encoding", encode),
]

#: The classifiers and fingerprints cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
