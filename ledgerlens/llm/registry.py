"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import mixing, near_dedup, quality_rules
from ledgerlens.llm.mixing import op8_source_mixing
from ledgerlens.llm.near_dedup import op10_near_dedup
from ledgerlens.llm.packing import op1_best_fit_packing
from ledgerlens.llm.quality_model import op5_quality_model
from ledgerlens.llm.quality_rules import op6_quality_rules
from ledgerlens.llm.search import op7_topk_search
from ledgerlens.llm.secret_scan import op3_secret_scan
from ledgerlens.llm.token_files import op4_token_files
from ledgerlens.llm.toxicity import op9_toxicity
from ledgerlens.llm.url_filter import op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_secret_scan, op4_token_files, op5_quality_model, op6_quality_rules, op7_topk_search, op8_source_mixing, op9_toxicity, op10_near_dedup)}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality_rules.SQL, "op8_source_mixing": mixing.SQL, "op10_near_dedup": near_dedup.SQL}
