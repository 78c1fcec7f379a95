"""The pN_ queries and their SQL."""

from __future__ import annotations

import importlib

from .common import table


def _of(module: str, function: str):
    """A query whose operator's module is loaded when the query runs."""
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), function)(spark, sf_dir)


def p7_ids(spark, sf_dir):
    from .tokenize import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def queries():
    return {
        "p1_found": _of("near_duplicates", "p1_found"),
        "p1_classes": _of("near_duplicates", "p1_classes"),
        "p2_found": _of("page_noise", "p2_found"),
        "p2_paragraphs": _of("page_noise", "p2_paragraphs"),
        "p3_found": _of("lookalikes", "p3_found"),
        "p3_unified": _of("lookalikes", "p3_unified"),
        "p4_found": _of("sentences", "p4_found"),
        "p5_found": _of("encoding_repair", "p5_found"),
        "p5_restored": _of("encoding_repair", "p5_restored"),
        "p6_found": _of("language_labels", "p6_found"),
        "p6_segments": _of("language_labels", "p6_segments"),
        "p7_ids": p7_ids,
        "p8_found": _of("leakage", "p8_found"),
        "p8_leaks": _of("leakage", "p8_leaks"),
        "p9_found": _of("personal_information", "p9_found"),
        "p9_redacted": _of("personal_information", "p9_redacted"),
    }


def oracle_sql():
    return {}
