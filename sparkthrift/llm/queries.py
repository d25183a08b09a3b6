"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_packing import op1_packing
from .op2_ann import op2_ann
from .op3_warc import OP3_SQL, op3_warc
from .op4_chat import OP4_SQL, op4_chat
from .op5_toxicity import op5_toxicity
from .op6_jaccard import op6_jaccard
from .op7_sharding import op7_sharding
from .op8_mixing import op8_mixing
from .op9_quality import op9_quality
from .op10_dedup import OP10_SQL, op10_exact_dedup
from .op11_resampling import OP11_SQL, op11_resampling
from .op12_quality_rules import OP12_SQL, op12_quality_rules
from .op13_codes import OP13_SQL, op13_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_ann, op3_warc, op4_chat, op5_toxicity, op6_jaccard, op7_sharding, op8_mixing, op9_quality, op10_exact_dedup, op11_resampling, op12_quality_rules, op13_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_chat": OP4_SQL, "op10_exact_dedup": OP10_SQL, "op11_resampling": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_codes": OP13_SQL}
