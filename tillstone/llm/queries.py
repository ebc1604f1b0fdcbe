"""The operators over their whole tables, and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstone.llm import bpe, brown, conversations, decontaminate, hosts, jaccard, langid, licences, mixing, oracles, simple8b, spelling, toxicity, urls
from tillstone.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _documents(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bpe": _documents(bpe.digests),
    "op2_toxicity": lambda spark, sf_dir: toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op3_url_filter": lambda spark, sf_dir: urls.judged(read(spark, sf_dir, "pages")),
    "op4_jaccard_join": _documents(jaccard.clustered),
    "op5_host_rules": _documents(hosts.judged),
    "op6_language_id": _documents(langid.identified),
    "op7_class_ngrams": _documents(brown.scored),
    "op8_licence_scan": _documents(licences.labelled),
    "op9_token_files": _documents(simple8b.round_trip),
    "op10_decontaminate": lambda spark, sf_dir: decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op11_source_mix": _documents(mixing.shares),
    "op12_conversation_repair": lambda spark, sf_dir: conversations.repair_audit(read(spark, sf_dir, "conversations")),
    "op13_spelling_variants": _documents(spelling.grouped),
}
ORACLE: dict[str, str] = {
    "op3_url_filter": oracles.url_filter(), "op5_host_rules": oracles.host_rules(), "op11_source_mix": oracles.mixing(),
}
