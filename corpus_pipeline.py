"""The corpus pipeline: documents in, token ids out.

Each stage takes what its predecessor kept, written as Parquet and read again,
and returns the columns of documents; the last one returns ids for the text.

All stages treat rows as their operators do. A null or empty text is a document
of its own: the quality rules reject it, the later stages would keep one of its
exact copies, never call it a near copy, give it the mean rate of its priors and
encode it as no ids. Rows that repeat an id share their fate. Ids may be null;
they are matched null-safe. Further columns are kept, whatever their names but
those that begin with two underscores. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing
from quern.llm.common import checkpoint_folder, table
from quern.llm.exact_dedup import drop_exact_copies
from quern.llm.near_dedup import drop_near_copies
from quern.llm.quality_rules import drop_low_quality

#: Token shares for rates of at most one: clean text stays whole, low and toxic text is thinned to its share beside it.
KEPT_MIXTURE = {"clean": 0.985, "low": 0.01, "toxic": 0.005}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the row with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low and toxic text is thinned to its share of what clean text there is; no rate is above one, so no document is repeated.

    The targets are the clean text's own tokens and, beside them, the others'
    shares or all they have.
    """
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.take_mixture(docs, labelled, KEPT_MIXTURE, most_rate=1.0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids for the text, with a digest of the bytes decoded from them."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    kept = [c for c in docs.columns if c != "text"]
    return encoded.select(*kept, F.expr("length(token_ids) div 4").cast("bigint").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_weights),
    ("byte-level BPE", byte_bpe),
]

#: SQL has no byte-level BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next reads them.

    A stage's folder is removed once its successor's is written; the one that
    the last, lazy stage reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, path = written(spark, docs)
            if before is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            before = path
    return docs


def written(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as Parquet in the checkpoint folder, read again, and its path."""
    path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path), path
