"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .ann import nearest
from .chat import rotate_perspectives
from .common import materialize, new_folder
from .line_dedup import dedup_lines
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import pack_documents
from .quality import judge_documents
from .repair import audit_conversations, damage_turns
from .sharding import byte_shards
from .substring_dedup import dedup_substrings
from .toxicity import score_documents, train
from .warc import assemble, read_archives, resolve, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5")
    )


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"),
    )


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_table(spark, sf_dir, "documents"))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda m: F.concat(m["start"], F.lit("+"), m["length"]))
    return rotate_perspectives(_table(spark, sf_dir, "conversations")).withColumn(
        "mask", F.array_join(spans, ",")
    )


def tokenizer_path() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written whole, so that the digests' few columns don't thin out what is copied and shuffled
    mixed = materialize(mix_sources(_table(spark, sf_dir, "documents")), "mixed")
    return mixed.select(
        "doc_id", "source", F.md5("text").alias("text_md5"), "mix_copy", "mix_copies", "mix_place"
    )


def op10_sentence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending")
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align_documents(
        _table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model")
    )
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return resolve(assemble(read_archives(spark, path)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return audit_conversations(damage_turns(turns), asked=turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_host_quality": op4_host_quality,
    "op5_posting_lists": op5_posting_lists,
    "op6_byte_shards": op6_byte_shards,
    "op7_perspectives": op7_perspectives,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_sentence_toxicity": op10_sentence_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_warc_captures": op12_warc_captures,
    "op13_conversation_repair": op13_conversation_repair,
}
