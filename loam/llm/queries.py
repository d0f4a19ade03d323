"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm.decontaminate import op2_decontamination
from loam.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from loam.llm.hyperminhash import OP13_SQL, op13_hyperminhash
from loam.llm.language import op4_language
from loam.llm.lengths import op6_token_counts
from loam.llm.licenses import op3_licenses
from loam.llm.merkle import OP12_SQL, op12_merkle_manifest
from loam.llm.packing import op10_packing
from loam.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from loam.llm.privacy import op5_private_data
from loam.llm.quality import op9_quality
from loam.llm.simhash import op8_simhash
from loam.llm.store import op1_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_private_data": op5_private_data,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hyperminhash": op13_hyperminhash,
}

ORACLE_SQL: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hyperminhash": OP13_SQL}
