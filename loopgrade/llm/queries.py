"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.llm import decontamination, divergence, language_id, lexical_search, mixing, quality_classifier, quality_rules, sanitise, simhash, suffix_dedup, token_counts, toxicity, transcripts
from loopgrade.llm.common import table
from loopgrade.llm.oracles import ORACLES  # noqa: F401


#: Folder of public vocabulary files; a parameter of every tokenizer query.
TOKENIZERS = "/opt/tokenizers"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start_word", "end_word")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), token_counts.load_pieces(f"{tokenizers}/piece_bpe_32k.model"))


def op5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are hidden from the operator; the table's own are read only to fit the model, outside fold 0."""
    convs = table(spark, sf_dir, "conversations")
    return transcripts.render(convs, transcripts.fit(convs)).select("conv_id", "turn", "part", "role", "rendered")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS[:4])]
    return found.select("row.doc_id", *counts, F.sha2(sanitise.listed(F.col("base")), 256).alias("base_sha256"), sanitise.listed(F.col("spans")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_quality_classifier, op4_token_counts, op5_transcripts, op6_simhash, op7_sanitise, op8_suffix_dedup, op9_mixing, op10_toxicity, op11_lexical_search, op12_language_id, op13_divergence)}
