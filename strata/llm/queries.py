"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses
from .decontamination import op9_decontamination
from .context_tree import op1_context_tree
from .licenses import op10_licenses
from .main_text import op3_main_text
from .nearest import op7_nearest
from .packing import op2_packing
from .simhash import op6_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op5_token_counts
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_context_tree, op2_packing, op3_main_text, op4_substring_dedup, op5_token_counts, op6_simhash, op7_nearest, op8_toxicity, op9_decontamination, op10_licenses)}
ORACLE_SQL: dict[str, str] = {"op9_decontamination": decontamination.ORACLE_SQL, "op10_licenses": licenses.ORACLE_SQL}
