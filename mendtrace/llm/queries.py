"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_tree import op1
from .collocations import op11
from .decontaminate import op3
from .jaccard_join import op5
from .language import op7
from .mih import op10
from .oracles import oracle_sql
from .packing import op4
from .perplexity import op13
from .pii import op9
from .quality import op6
from .repeats import op8
from .resample import op12
from .secrets import op2

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_prefix_tree": op1,
        "op2_credential_linking": op2,
        "op3_template_decontamination": op3,
        "op4_best_two_fit": op4,
        "op5_jaccard_join": op5,
        "op6_additive_quality": op6,
        "op7_string_kernel_language": op7,
        "op8_bucket_pointer_dedup": op8,
        "op9_anchor_pii": op9,
        "op10_multi_index_hashing": op10,
        "op11_phrase_collocations": op11,
        "op12_importance_resampling": op12,
        "op13_perplexity_rules": op13,
    }
