"""Registered queries of the operators: name -> builder over (spark, sf_dir), and the SQL of those that SQL can express.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (conversations, decontaminate, embed_dedup, html_text, lattice_lm, licenses, minhash, neighbours, oracle, phrases, quality,
               sentencepiece_bpe, substring, token_files)
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_counting_dedup": lambda s, d: embed_dedup.report(table(s, d, "embeddings")),
    "op2_collinear_passages": lambda s, d: substring.report(table(s, d, "documents")),
    "op3_scored_html_region": lambda s, d: html_text.extract(table(s, d, "pages")),
    "op4_probminhash_dedup": lambda s, d: minhash.report(table(s, d, "documents")),
    "op5_wu_manber_decontamination": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_token_files": lambda s, d: token_files.report(table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op7_license_windows": lambda s, d: licenses.report(table(s, d, "documents")),
    "op8_subword_quality": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
    "op9_sentencepiece_backtracking": lambda s, d: sentencepiece_bpe.report(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op10_subword_lattice_lm": lambda s, d: lattice_lm.report(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op11_coalescing_viterbi_repair": lambda s, d: conversations.report(table(s, d, "conversations")),
    "op12_suffix_subtree_phrases": lambda s, d: phrases.mine(table(s, d, "documents")),
    "op13_learned_partition_neighbours": lambda s, d: neighbours.search(table(s, d, "embeddings")),
}

ORACLE: dict[str, str] = {
    "op1_collision_counting_dedup": oracle.EMBEDDINGS,
    "op3_scored_html_region": oracle.PAGES,
    "op5_wu_manber_decontamination": oracle.BENCHMARK,
    "op11_coalescing_viterbi_repair": oracle.CONVERSATIONS,
    "op12_suffix_subtree_phrases": oracle.PHRASES,
}
