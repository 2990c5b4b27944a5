"""One registered query for each operator, and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawlspark.llm import edits, idblocks, langid, maintext, mixing, neardup, packing, prefixtrie, quality, simhash, topk, variants, warc
from trawlspark.llm.tokens import vocabulary_path
from trawlspark.session import prepare, work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = work_folder(spark, "idblocks")
    idblocks.write_ids(docs, path, vocabulary_path("word_bpe_49k.json"), drops_space=True, end_id=2)
    return idblocks.read_ids(spark, path)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=1)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, work_folder(spark, "warc"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.assess(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return maintext.extract(pages)


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    log = edits.derived_edits(docs.select("doc_id", "n_chars", "source"))
    return edits.edited_counts(docs.select("doc_id", "text"), log, vocabulary_path("byte_bpe_50k.json"))


def op11_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(prefixtrie.regrafted(_table(spark, sf_dir, "conversations")))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_blocks": op2_token_blocks,
        "op3_pack_sequences": op3_pack_sequences,
        "op4_mix_sources": op4_mix_sources,
        "op5_warc_chunks": op5_warc_chunks,
        "op6_quality_rules": op6_quality_rules,
        "op7_main_text": op7_main_text,
        "op8_top_k_search": op8_top_k_search,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_edited_token_counts": op10_edited_token_counts,
        "op11_simhash_grid": op11_simhash_grid,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_prefix_trie": op13_prefix_trie,
    }
