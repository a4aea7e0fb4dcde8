"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import checks
from tallyscope.llm.common import table
from tallyscope.llm.conversation_trie import encoded as encoded_turns
from tallyscope.llm.conversation_trie import prefix_trie, rebuilt
from tallyscope.llm.decontamination import contamination
from tallyscope.llm.html_text import page_texts
from tallyscope.llm.lexical_search import lexical_search
from tallyscope.llm.license_scan import license_scan
from tallyscope.llm.near_dups import near_duplicates
from tallyscope.llm.personal_data import personal_data
from tallyscope.llm.quality_model import quality_scores
from tallyscope.llm.quality_rules import quality_report
from tallyscope.llm.registry import query
from tallyscope.llm.repeats import without_repeats
from tallyscope.llm.sentence_pieces import encoded
from tallyscope.llm.token_counts import token_counts
from tallyscope.llm.toxicity import toxicity


@query("op1_quality_rules", checks.quality_rules())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def tokenizer() -> bytes:
    """The model file all token queries use; some hundred kilobytes."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer())


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_sentence_pieces")
def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer())


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_license_scan", checks.license_scan())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


@query("op13_lexical_search", checks.lexical_search())
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_trie", checks.conversation_trie())
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(encoded_turns(table(spark, sf_dir, "conversations"))))
    return nodes.selectExpr(
        "conv AS conv_id", "depth", "parent_conv AS parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved AS saved_tokens", "ends AS ends_sha256",
    )


@query("op12_repeats")
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_bytes", "n_bytes - octet_length(kept) AS n_removed", "CAST(size(spans) AS BIGINT) AS n_spans", "sha2(kept, 256) AS kept_sha256"
    )
