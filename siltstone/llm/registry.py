"""The queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import chat_tree, decontamination, ego_join, html_text, licenses, line_dedup, packing, quality, runs, simhash, tokens, turns, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_tree": chat_tree.op1_chat_tree,
        "op2_html_text": html_text.op2_html_text,
        "op3_tokens": tokens.op3_tokens,
        "op4_quality": quality.op4_quality,
        "op5_simhash": simhash.op5_simhash,
        "op6_ego_join": ego_join.op6_ego_join,
        "op7_licenses": licenses.op7_licenses,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_packing": packing.op10_packing,
        "op11_runs": runs.op11_runs,
        "op12_warc": warc.op12_warc,
        "op13_turns": turns.op13_turns,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_licenses": licenses.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op12_warc": warc.ORACLE_SQL,
    }
