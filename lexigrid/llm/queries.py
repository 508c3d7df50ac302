"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bfd_packing import op1_bfd_packing
from .bpe_fst import op10_bpe_fst
from .chat_events import OP4_SQL, op4_chat_events
from .license_scan import op3_license_scan
from .line_quality import OP7_SQL, op7_line_quality
from .ogg_media import op2_ogg_media
from .pow2_packing import op5_pow2_packing
from .simhash_gph import op9_simhash_gph
from .spelling_variants import op13_spelling_variants
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .tier_compaction import OP8_SQL, op8_tier_compaction
from .toxicity import op12_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_bfd_packing, op2_ogg_media, op3_license_scan, op4_chat_events, op5_pow2_packing, op6_substring_dedup, op7_line_quality, op8_tier_compaction, op9_simhash_gph, op10_bpe_fst,
        op11_vector_codes, op12_toxicity, op13_spelling_variants,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_events": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_line_quality": OP7_SQL, "op8_tier_compaction": OP8_SQL, "op11_vector_codes": OP11_SQL}
