"""Documents to training tokens: quality, near copies, benchmark passages, mixture, token files.

Every stage takes what its predecessor kept, written and read again, and all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearshelf.llm.decontaminate import find_contamination
from nearshelf.llm.jaccard_join import keep_first
from nearshelf.llm.mixing import WEIGHTS, mix_sources
from nearshelf.llm.quality_rules import quality_rules
from nearshelf.llm.tables import small, written
from nearshelf.llm.token_shards import read_documents, write_token_shards
from nearshelf.session import work_folder

#: A text further from its language's common words than this share of the way to a text with none is rejected.
COMMON_SHARE = 0.8


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key per row, so that rows without doc_id, or with one doc_id, are judged one by one; the key's name."""
    name = "_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """docs but for the rows with the one key column's values."""
    keyed, key = _keyed(docs)
    drop = written(keys.toDF(key).distinct(), name)
    return keyed.join(small(drop), key, "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed, key = _keyed(docs)
    judged = quality_rules(keyed.select("text", "lang", F.col(key).alias("key")), keep=["key"], max_common_share=COMMON_SHARE)
    return _without(docs, judged.where("NOT kept").select("key"), "rejected")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return keep_first(docs, width=5, percent=80).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds a benchmark item."""
    keyed, key = _keyed(docs)
    hits = find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key)
    return _without(docs, hits.select("doc_id"), "contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their rates: none most likely of a domain of weight 0, all most likely good, the rest to fit the weights."""
    keyed, key = _keyed(docs)
    rated = mix_sources(keyed.select("doc_id", "text", key), spark.read.parquet(f"{sf_dir}/labels.parquet"), weights=WEIGHTS, whole="good", carry=[key])
    return _without(docs, rated.where("NOT kept").select(key), "not-drawn")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents, read from the token files that it writes."""
    out = work_folder(spark, "pipeline-tokens")
    write_token_shards(docs, out, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, out)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-id output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs


#: Shingle links, the fitted classifier and the tokenizer have no SQL form; tests compare with plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
