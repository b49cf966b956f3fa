"""The corpus operators' registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import common, filter_audit, html_text, jaccard, language, licenses, minhash, packing, pieces, quality, suffix, token_files, toxicity, whitening


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.without_repeats(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.fit(docs, keep=common.id_fold(F.col("doc_id"), 3) != 1)
    found = language.identify(docs, model)
    return found.select("doc_id", (common.id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(common.table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "title", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(common.table(spark, sf_dir, "documents"))
    names = F.transform("matches", lambda m: m["license"])
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_sort(F.array_distinct(names)).alias("licenses"), "matches")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), keep=common.id_fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", (common.id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text: how many, a hash of their ids, and whether decoding gives the text back."""
    path = tokenizer("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("was"))
    encoded = pieces.encode(docs, path, keep=("doc_id", "was"))
    decoded = pieces.decode(encoded, path, keep=("doc_id", "was", "ids"))
    return decoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).eqNullSafe(F.col("was")).alias("lossless"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it is no long."""
    table = common.table(spark, sf_dir, "embeddings")
    common.bound_batches(spark)
    model = whitening.fit(table)
    rows = whitening.whiten(table, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(float(model.identity_error)).alias("identity_error")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back from there."""
    path = common.new_path(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_language_id": op2_language_id,
        "op3_html_extraction": op3_html_extraction,
        "op4_license_scans": op4_license_scans,
        "op5_quality_rules": op5_quality_rules,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_toxicity": op7_toxicity,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_sampled_pieces": op10_sampled_pieces,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_filter_audit": op12_filter_audit,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": filter_audit.SQL}
