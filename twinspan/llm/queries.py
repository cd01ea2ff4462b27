"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinspan.llm import html_text, jaccard_join, licences, mixing, neighbours, packing, quality_classifier, quality_rules, toxicity, warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_html_text": html_text.query,
    "op3_warc_fixity": warc_fixity.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_toxicity": toxicity.query,
    "op6_neighbours": neighbours.query,
    "op7_mixing": mixing.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_licences": licences.query,
    "op10_packing": packing.query,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules.SQL, "op4_jaccard_join": jaccard_join.SQL}
