"""The queries opN_<name>, each over its whole table."""

from __future__ import annotations

from weftline.llm import chat, decontaminate, embedding_dedup, language_id, license_scan, packing, secrets, simhash, toxicity, warc
from weftline.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


@query("op8_language_id")
def op8(spark, sf_dir):
    return language_id.op8(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark, sf_dir):
    return simhash.op7(table(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10(spark, sf_dir):
    return decontaminate.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_secret_scan")
def op6(spark, sf_dir):
    return secrets.op6(table(spark, sf_dir, "documents"))


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.op1(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_embedding_dedup")
def op9(spark, sf_dir):
    return embedding_dedup.op9(table(spark, sf_dir, "embeddings"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    return license_scan.op5(table(spark, sf_dir, "documents"))


@query("op2_chat_format", chat.SQL)
def op2(spark, sf_dir):
    return chat.op2(table(spark, sf_dir, "conversations"))


@query("op3_warc_derivatives")
def op3(spark, sf_dir):
    return warc.op3(table(spark, sf_dir, "pages"))
