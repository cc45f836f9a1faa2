"""Queries of the numbered operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import ann, bpe, dedup, html, lm, mixing, neardup, packing, prefix_trie, repair, sharding, toxicity, urls
from .shared import table


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark, sf_dir):
    return neardup.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), whole=True)


def op8_stratified_shards(spark, sf_dir):
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op10_sum_of_squares_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


def op13_structure_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(conversations), conversations)


DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: f for k, f in globals().items() if (k.startswith("op") or k == "pipeline") and callable(f)}


def oracle_sql():
    return {"op5_exact_dedup": DEDUP_SQL, "op6_url_filters": urls.judge_sql(), "op11_source_mixing": mixing.mix_sql(), "op12_prefix_trie": prefix_trie.trie_sql(), "op13_structure_repair": repair.repair_sql()}
