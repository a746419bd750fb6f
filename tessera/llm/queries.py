"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op2_cgk_decontamination
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import OP9_SQL, op9_source_mixing
from .negatives import OP13_SQL, op13_hard_negatives
from .neardup import op4_tensored_minhash
from .oracles import OP4_SQL, OP5_SQL
from .pii import op3_pii_deobfuscation
from .planes import op12_bit_planes
from .rendering import op6_layout_rendering
from .sharding import op7_feistel_sharding
from .toxicity import op10_ordinal_toxicity
from .urls import op1_url_gbt_filter
from .vectors import op5_rotation_codes
from .warc import op8_warc_round_trip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_gbt_filter": op1_url_gbt_filter,
        "op2_cgk_decontamination": op2_cgk_decontamination,
        "op3_pii_deobfuscation": op3_pii_deobfuscation,
        "op4_tensored_minhash": op4_tensored_minhash,
        "op5_rotation_codes": op5_rotation_codes,
        "op6_layout_rendering": op6_layout_rendering,
        "op7_feistel_sharding": op7_feistel_sharding,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_source_mixing": op9_source_mixing,
        "op10_ordinal_toxicity": op10_ordinal_toxicity,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_bit_planes": op12_bit_planes,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_tensored_minhash": OP4_SQL, "op5_rotation_codes": OP5_SQL, "op9_source_mixing": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_hard_negatives": OP13_SQL}
