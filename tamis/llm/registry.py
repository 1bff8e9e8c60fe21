"""The subpackage's queries over the driver's tables, with SQL where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import chat, lines, shards, urls
from tamis.llm.decontaminate import contaminated
from tamis.llm.html import extract
from tamis.llm.packing import pack
from tamis.llm.quality import classify
from tamis.llm.simhash import simhash_components
from tamis.llm.vectors import near_vectors
from tamis.session import ship
from tamis.tables import place

Query = Callable[[SparkSession, str], DataFrame]
#: The rules (host, path, verdict) that op7 is asked to apply.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file: in ``TAMIS_TOKENIZERS``, or the installed package's folder."""
    if "TAMIS_TOKENIZERS" in os.environ:
        return os.path.join(os.environ["TAMIS_TOKENIZERS"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query(lines.SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), lines_col="n_lines", removed_col="n_removed")


@query(urls.sql(RULES))
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: Tools that the conversations may call, by name, with the schema of their arguments.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


@query(chat.SQL)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), TOOLS)


@query()
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = shards.training_order(table(spark, sf_dir, "documents"), vocabulary())
    path = place(spark)
    shards.write_shards(ordered, path, stride=2048, per_shard=4096)
    return shards.digest_shards(spark, path, stride=2048)
