"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from tessera.llm import chat, context_mix, decontaminate, fingerprint, html_text, mixing, pii, quality, set_join, url_filter
from tessera.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_context_mixing(spark, sf_dir):
    return context_mix.query(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return fingerprint.query(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    return chat.digest(chat.format_chats(chat.with_hard_case(table(spark, sf_dir, "conversations"))))


def op5_quality(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark, sf_dir):
    return html_text.query(table(spark, sf_dir, "pages"))


def op7_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.listed_sites(spark))


def op8_ngram_join(spark, sf_dir):
    return set_join.query(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("mix_row")


def queries():
    return {f.__name__: f for f in (op1_decontaminate, op2_context_mixing, op3_fingerprints, op4_chat_format, op5_quality, op6_html_text, op7_url_filter, op8_ngram_join, op9_pii, op10_mix_sources)}


def oracle_sql():
    return {"op1_decontaminate": decontaminate.oracle(), "op4_chat_format": chat.oracle(), "op6_html_text": html_text.oracle(), "op7_url_filter": url_filter.oracle(), "op8_ngram_join": set_join.oracle(), "op10_mix_sources": mixing.oracle()}
