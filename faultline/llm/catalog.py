"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.llm import licenses, mixing
from faultline.llm.conversation_repair import damage, repair_conversations
from faultline.llm.conversation_trie import conversation_paths, prefix_trie, rebuilt
from faultline.llm.embedding_dedup import near_embeddings
from faultline.llm.fingerprints import compare_with_next
from faultline.llm.html_text import extract_text
from faultline.llm.near_dedup import near_duplicates
from faultline.llm.nearest import nearest
from faultline.llm.packed_matrix import pack_matrix
from faultline.llm.packing import pack_concat
from faultline.llm.token_counts import count_tokens
from faultline.llm.toxicity import fit_toxicity, held_out, score_toxicity
from faultline.sources.panel import read_table


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("found")


def op3_source_mixing(spark, sf_dir):
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_packing(spark, sf_dir):
    pieces = pack_concat(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op7_packed_matrix(spark, sf_dir):
    return pack_matrix(read_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark, sf_dir):
    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark, sf_dir):
    return near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark, sf_dir):
    return extract_text(read_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark, sf_dir):
    return repair_conversations(damage(read_table(spark, sf_dir, "conversations")))


def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(rebuilt(conversation_paths(read_table(spark, sf_dir, "conversations"))))


def op13_nearest_neighbours(spark, sf_dir):
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_license_scan, op3_source_mixing, op4_token_counts,
                                   op5_toxicity, op6_packing, op7_packed_matrix, op8_fingerprints,
                                   op9_embedding_near_dedup, op10_html_extraction, op11_conversation_repair,
                                   op12_conversation_trie, op13_nearest_neighbours)}
ORACLE: dict[str, str] = {"op2_license_scan": licenses.sql(), "op3_source_mixing": mixing.SQL}
