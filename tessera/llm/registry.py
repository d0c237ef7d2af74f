"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontamination, langid, linededup, packing, quality, simhash, tiff, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_url_filters": urlfilter.op2_url_filters,
        "op3_warc_revisits": warc.op3_warc_revisits,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_tiff_media": tiff.op8_tiff_media,
        "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": urlfilter.OP2_SQL,
        "op3_warc_revisits": warc.OP3_SQL,
        "op5_chat_formatting": chat.OP5_SQL,
        "op9_benchmark_decontamination": decontamination.OP9_SQL,
    }
