"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import chat, decontam, langid, near_dups, packing, quality, secret_scan, substring, toxicity, urls
from .common import table


def op1_decontamination(spark, sf_dir):
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_divergence(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_url_segmentation(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op4_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity_neighbours(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_windows(spark, sf_dir):
    return chat.digests(chat.format_windows(chat.with_attack(table(spark, sf_dir, "conversations"))))


def op7_simhash_near_dups(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = [op1_decontamination, op2_quality_divergence, op3_url_segmentation, op4_harmonic_packing, op5_toxicity_neighbours, op6_chat_windows, op7_simhash_near_dups, op8_secret_scan, op9_substring_dedup, op10_language_id]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict:
    return {"op2_quality_divergence": quality.oracle_sql(), "op9_substring_dedup": substring.oracle_sql()}
