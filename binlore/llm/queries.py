"""Queries over the operators of this subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, quality, sharding, warc
from .chat import op3_chat_template
from .decontaminate import op10_suffix_array_matches
from .extract import op4_block_labeller
from .jaccard import op1_ngram_jaccard_components
from .lines import op6_fuzzy_lines
from .packing import op5_minimum_slack_packing
from .quality import op9_host_rules
from .records import op7_record_files
from .sharding import op8_hash_tree_shards
from .warc import op2_revisit_resolution


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_components, op2_revisit_resolution, op3_chat_template, op4_block_labeller, op5_minimum_slack_packing, op6_fuzzy_lines, op7_record_files, op8_hash_tree_shards, op9_host_rules, op10_suffix_array_matches]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_revisit_resolution": warc.ORACLE, "op3_chat_template": chat.ORACLE, "op8_hash_tree_shards": sharding.ORACLE, "op9_host_rules": quality.ORACLE, "op10_suffix_array_matches": decontaminate.ORACLE}
