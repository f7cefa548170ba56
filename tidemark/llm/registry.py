"""Queries of the operators, one per operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import op9_byte_bpe
from tidemark.llm.codes import op11_vector_codes
from tidemark.llm.fingerprints import op10_fingerprints
from tidemark.llm.flac import op2_flac_media
from tidemark.llm.language import op7_language
from tidemark.llm.lines import op1_line_dedup
from tidemark.llm.mixing import op5_mixing
from tidemark.llm.negatives import op13_hard_negatives
from tidemark.llm.personal_data import op8_personal_data
from tidemark.llm.simhash import op3_simhash
from tidemark.llm.substring import op6_substring_dedup
from tidemark.llm.sql import ORACLE
from tidemark.llm.token_counts import op4_token_counts
from tidemark.llm.warc import op12_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_flac_media": op2_flac_media,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language": op7_language,
    "op8_personal_data": op8_personal_data,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLE", "QUERIES"]
