"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_template_decontamination
from .language_id import op12_ftrl_languages
from .language_model import op8_bilinear_scores
from .licenses import op7_license_scan
from .merkle import op10_merkle_fingerprints
from .packing import op5_power_of_two_packing
from .quality import op9_line_crf_quality
from .sharding import op6_byte_shards
from .simhash import op2_simhash_components
from .spelling import op13_spelling_variants
from .substrings import op3_gear_chunk_dedup
from .toxicity import op1_subword_toxicity
from .whitening import op11_lanczos_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_subword_toxicity,
        op2_simhash_components,
        op3_gear_chunk_dedup,
        op4_template_decontamination,
        op5_power_of_two_packing,
        op6_byte_shards,
        op7_license_scan,
        op8_bilinear_scores,
        op9_line_crf_quality,
        op10_merkle_fingerprints,
        op11_lanczos_whitening,
        op12_ftrl_languages,
        op13_spelling_variants,
    )
}

#: crc32 of texts has no DuckDB function, and models, tokenizers and iterated
#: components have none either; these are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {}
