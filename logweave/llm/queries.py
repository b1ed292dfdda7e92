"""Queries of this subpackage, by name."""

import corpus_pipeline

from . import topk
from .html_extract import op9_html_extraction
from .mixing import op3_mixing
from .near_dedup import op7_near_dedup
from .packing import op6_packing
from .pii import op1_pii
from .quality_cnn import op10_quality_cnn
from .quality_rules import op4_quality_rules
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .topk import op5_topk_search

ALL = (op1_pii, op2_substring_dedup, op3_mixing, op4_quality_rules, op5_topk_search, op6_packing, op7_near_dedup, op8_suffix_dedup, op9_html_extraction, op10_quality_cnn)


def queries():
    return {f.__name__: f for f in ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op5_topk_search": topk.ORACLE}
