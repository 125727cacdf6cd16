"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblioloom.llm import chat, decontamination, hard_negatives, html_extraction, licenses, lm_scoring, packing, pii, quality_rules, secret_scan, simhash, url_filters, vector_codes
from biblioloom.llm.common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def url_rules_by_language(spark, sf_dir):
    return url_filters.judge_by_language(table(spark, sf_dir, "pages"))


def op2_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir):
    model = html_extraction.train(html_extraction.labelled_pages())
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"), model)


def op5_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.assess(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_chat(spark, sf_dir):
    return chat.digest(chat.with_extra(table(spark, sf_dir, "conversations")))


def chat_typed_parts(spark, sf_dir):
    return chat.parts_digest(chat.with_parts(table(spark, sf_dir, "conversations")))


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


def op13_secret_scan(spark, sf_dir):
    return secret_scan.find(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_decontamination, op3_simhash, op4_html_extraction, op5_lm_scoring, op6_licenses, op7_quality_rules, op8_chat, op9_pii, op10_packing,
        op11_vector_codes, op12_hard_negatives, op13_secret_scan,
        url_rules_by_language, chat_typed_parts,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filters.oracle_sql(),
    "url_rules_by_language": url_filters.oracle_sql(url_filters.BY_LANGUAGE, ()),
    "op6_licenses": licenses.oracle_sql(),
    "op8_chat": chat.oracle_sql(),
    "chat_typed_parts": chat.parts_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
}
