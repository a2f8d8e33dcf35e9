"""Registered queries of this folder and, where SQL can say it, their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearshelf.llm.collocations import mine_phrases
from nearshelf.llm.decontaminate import find_contamination
from nearshelf.llm.fill_in_middle import fill_in_middle, restored
from nearshelf.llm.jaccard_join import similar_components
from nearshelf.llm.language_id import identify_language
from nearshelf.llm.line_dedup import dedup_lines
from nearshelf.llm.mixing import mix_sources
from nearshelf.llm.packing import pack_documents
from nearshelf.llm.quality_rules import quality_rules
from nearshelf.llm.secret_scan import scan_secrets, spans_text
from nearshelf.llm.sql import OP2, OP5, OP9, OP11, OP12
from nearshelf.llm.suffix_dedup import repeated_bytes
from nearshelf.llm.token_shards import read_documents, write_token_shards
from nearshelf.llm.url_filter import filter_urls
from nearshelf.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), width=4, percent=85)


@query(OP2)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), keep=["doc_id"], max_common_share=0.8).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_common", "kept")


@query()
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = work_folder(spark, "tokens")
    write_token_shards(documents(spark, sf_dir), out, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, out)


@query()
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query(OP5)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2("text", 256).alias("text_sha256"))


@query()
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify_language(documents(spark, sf_dir), model=public_tokenizers.path("piece_bpe_32k.model"))


@query(OP9)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query()
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(OP11)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir))


@query(OP12)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
