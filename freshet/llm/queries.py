"""The text operators as queries on the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    block_naming, collocations, html_layout, jaccard_join, language_id, lattice_dedup, license_scan, mixing, multi_index_search,
    packing, recurrent_lm, spelling, suffix_dedup,
)
from .common import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(tuned(spark), sf_dir)
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_lattice_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_multi_index_search")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_search.nearest(table(spark, sf_dir, "embeddings"))


@query("op4_html_layout")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its visible text."""
    return html_layout.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")


@query("op2_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot in a mixture whose weights are the square roots of the sources' sizes."""
    placed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", "mix_block", "mix_release", "mix_due", "mix_slot", "mix_place")


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_recurrent_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of_documents(table(spark, sf_dir, "documents"))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


ORACLES["op9_license_scan"] = license_scan.oracle()


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op11_block_naming")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_block_naming"] = block_naming.ORACLE


@query("op12_phrase_stripes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrase_scores(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_stripes"] = collocations.ORACLE


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = spelling.ORACLE
