"""The queries of this package: each takes (spark, sf_dir) and runs its operator over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op2_token_store import stored

    return stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_revisits import revisits

    return revisits(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100, width=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_quality_classifier import scores

    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_mixing import taken

    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op9_token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from .op10_sentencepiece import round_trip

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", "text", round_trip(path)(F.col("text")).alias("done"))
    return out.select("doc_id", F.size("done.ids").cast("long").alias("n_ids"), "done.ids", F.col("done.text").eqNullSafe(F.col("text")).alias("restored"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_conversation_trie import rebuilt, trie

    return trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=80, den=100, width=4)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_store, op3_revisits, op4_jaccard_join, op5_quality_rules, op6_quality_classifier, op7_nearest, op8_mixing, op9_token_counts, op10_sentencepiece, op11_filter_audit, op12_conversation_trie, op13_minhash_dedup)}


def _oracles() -> dict[str, str]:
    from . import op3_revisits as revisits
    from . import op11_filter_audit as audit
    from . import op12_conversation_trie as tries
    from . import sql

    return {"op3_revisits": revisits.SQL, "op11_filter_audit": audit.SQL, "op12_conversation_trie": tries.SQL, **sql.ORACLES}


ORACLE_SQL: dict[str, str] = _oracles()
