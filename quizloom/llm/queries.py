"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import (
    audit, automaton, bpe, decontaminate, hnsw, infill, language_id, secrets, simhash, token_files, toxicity, urls, warc,
)
from quizloom.llm.tables import fold, is_fold, table
from quizloom.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


@query
def op4_warc_bundles(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    index = warc.archive(spark, table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    records = warc.read_bundles(index, f"{folder}/bundles", with_payload=False)
    return warc.resolve_revisits(records).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SITE_RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)


@query
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, "url", SITE_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"
    )


@query
def op3_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op5_byte_bpe(spark, sf_dir):
    return encoded_digests(table(spark, sf_dir, "documents")).drop("ids")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Ids of each text, their number and digest, and the digest of the bytes decoded from them."""
    encoded = bpe.encode_rows(
        docs.select("doc_id", "text"), "text", RANKS, public_tokenizers.PATTERN, decoded="decoded", keep_text=False
    )
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


WORDS = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


@query
def op10_token_files(spark, sf_dir):
    folder, docs = scratch_path(spark, "tokens"), table(spark, sf_dir, "documents")
    manifest = token_files.store(spark, docs, folder, "doc_id", "text", WORDS, END_ID)
    return token_files.read_shards(manifest, f"{folder}/shards").select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32"
    )


@query
def op2_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query
def op6_secret_scan(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.find_secrets(F.col("text")).alias("all"))
    kinds = [rule.kind for rule in secrets.BASE_RULES]

    def count_of(kind: str):
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count_of(kind) for kind in kinds}
    base = F.filter("all", lambda s: s["kind"].isin(kinds))
    return found.withColumns(counts).select(
        "doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("all")).alias("spans"),
    )


LABEL_PARTS = 5


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Learnt from labelled rows outside the held-out fold."""
    learnt = docs.where(fold("doc_id", LABEL_PARTS) != 0).select("doc_id", "text")
    rows = toxicity.label_rows(learnt, labels, "doc_id", "toxic", "_toxic")
    return toxicity.fit(rows, "text", F.col("_toxic"))


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.add_score(docs, model).select(
        "doc_id", is_fold("doc_id", LABEL_PARTS, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


ASK_EVERY = 100
NEAREST = 10


@query
def op9_hnsw_search(spark, sf_dir):
    folder = scratch_path(spark, "hnsw")
    rows = hnsw.valid_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    hnsw.build_index(rows).write.parquet(folder)
    asked = rows.where(F.col("id") % ASK_EVERY == 0)
    found = hnsw.search(spark, spark.read.parquet(folder), rows, asked, NEAREST)
    return found.select(
        "query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score")
    )


LANGUAGE_PARTS = 4


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = docs.where(fold("doc_id", LANGUAGE_PARTS) != 2)
    model = language_id.fit(learnt, "text", F.col("lang"))
    return language_id.add_language(docs.drop("lang"), model).select(
        "doc_id", is_fold("doc_id", LANGUAGE_PARTS, 2).alias("held_out"), "lang_pred", "score"
    )


MERGES = public_tokenizers.path("byte_bpe_50k.json")


@query
def op11_automaton_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = automaton.encode_rows(docs, "text", MERGES, decoded="decoded", keep_text=False)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = infill.transform(docs, "doc_id", "text", keep_text=False)
    return infill.undo(made, keep_text=False).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


@query
def op13_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))
