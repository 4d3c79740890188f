"""The registered queries of the corpus operators."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from . import embeddings, language, licenses, mixing, packing, quality, simhash, toxicity, url_filters, warc
from .common import cut, table


@functools.cache
def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(quality.labelled_rows(docs, table(spark, sf_dir, "labels"))))


def op2_warc(spark, sf_dir):
    """Archives are written once, into the shared folder, and every figure below comes from reading them back."""
    pages = table(spark, sf_dir, "pages")
    archives = cut(warc.write(warc.with_revisits(pages), warc.train_dictionary(pages)))
    of = lambda urn: F.expr(f"try_cast(substring({urn}, 10) as bigint)")
    return warc.read(archives, payloads=False).select(of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to_id").alias("refers_to"))


def op3_language(spark, sf_dir):
    return language.evaluate(table(spark, sf_dir, "documents"))


def op4_url_filters(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, url_filters.RULES))


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), cached_chunks=450_000)


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.evaluate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_warc, op3_language, op4_url_filters, op5_packing, op6_simhash, op7_licenses, op8_mixing, op9_embeddings, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_filters.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
