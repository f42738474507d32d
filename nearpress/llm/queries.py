"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearpress.llm import lookalike, mainbody, mixing, nearcopies, packing, residue, sitelines, stuffing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": mainbody.p1_found,
    "p2_found": nearcopies.p2_found,
    "p2_groups": nearcopies.p2_groups,
    "p2_documents": nearcopies.p2_documents,
    "p3_found": sitelines.p3_found,
    "p3_clean": sitelines.p3_clean,
    "p4_found": residue.p4_found,
    "p4_reasons": residue.p4_reasons,
    "p5_found": lookalike.p5_found,
    "p5_forms": lookalike.p5_forms,
    "p6_packed": packing.p6_packed,
    "p6_fill": packing.p6_fill,
    "p6_words": packing.p6_words,
    "p7_mixed": mixing.p7_mixed,
    "p7_report": mixing.p7_report,
    "p7_filled": mixing.p7_filled,
    "p7_amounts": mixing.p7_amounts,
    "p8_found": stuffing.p8_found,
    "p8_scores": stuffing.p8_scores,
}

ORACLES: dict[str, str] = {**nearcopies.ORACLE, **sitelines.ORACLE, **lookalike.ORACLE, **packing.ORACLE, **mixing.ORACLE}
