"""Registered queries of the operators, over whole tables with production parameters.

``load()`` returns {name: query} and {name: DuckDB SQL}. Operators that SQL can't express,
or not in reasonable time on whole tables, have no SQL here and are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.llm.bpe import encoded
from evalmill.llm.chat_views import ROTATED_SQL, rotated
from evalmill.llm.common import table
from evalmill.llm.decontaminate import contaminated
from evalmill.llm.embedding_dedup import near_duplicates
from evalmill.llm.host_trust import JUDGED_SQL, judged
from evalmill.llm.language_id import language_report
from evalmill.llm.main_text import main_texts
from evalmill.llm.manifest import MANIFEST_SQL, document_manifest
from evalmill.llm.ngram_join import jaccard_components
from evalmill.llm.pii import pii_report
from evalmill.llm.pu_quality import quality_scores
from evalmill.llm.substring_dedup import repeats_removed
from evalmill.llm.whitening import whitened

#: The vocabulary of op4: a file of the public tokenizers package.
VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest of every contaminated document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op5_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return language_report(table(spark, sf_dir, "documents"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every document."""
    return pii_report(table(spark, sf_dir, "documents"))


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return repeats_removed(table(spark, sf_dir, "documents")).drop("kept")


def op8_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return main_texts(table(spark, sf_dir, "pages"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every participant's view of every dialogue."""
    return rotated(table(spark, sf_dir, "conversations"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    return document_manifest(table(spark, sf_dir, "documents"))


def op12_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judged(table(spark, sf_dir, "pages"))


def op13_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable vector."""
    return whitened(table(spark, sf_dir, "embeddings"))


def load() -> tuple[dict[str, Query], dict[str, str]]:
    found = {
        "op1_pu_quality": op1_pu_quality,
        "op2_greedy_tiling": op2_greedy_tiling,
        "op3_pivot_permutation": op3_pivot_permutation,
        "op4_bpe_lexicon": op4_bpe_lexicon,
        "op5_viterbi_language": op5_viterbi_language,
        "op6_bootstrapped_pii": op6_bootstrapped_pii,
        "op7_difference_cover": op7_difference_cover,
        "op8_tree_scoring": op8_tree_scoring,
        "op9_perspective_rotation": op9_perspective_rotation,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_midstate_manifest": op11_midstate_manifest,
        "op12_link_propagation": op12_link_propagation,
        "op13_jacobi_davidson": op13_jacobi_davidson,
    }
    sql = {"op9_perspective_rotation": ROTATED_SQL, "op11_midstate_manifest": MANIFEST_SQL, "op12_link_propagation": JUDGED_SQL}
    return found, sql
