"""One query for each operator, over its whole table, with production parameters.

The operators keep their own results (texts, spans, segments); the queries derive the
digests of the contract from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm import (
    chat,
    collocations,
    decontaminate,
    fingerprints,
    jaccard,
    katz,
    lines,
    packing,
    secrets,
    substrings,
    toxicity,
    urls,
    whitening,
)

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
TOXIC_FROM = 0.7
EXTRA_CHAT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secrets.BASE_RULES]
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        sha256(secrets.spelled(F.filter("spans", lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = fingerprints.edited_neighbours(docs, fingerprints.fit_lexicon(docs))
    return marked.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_CHAT), (-7, 1, "assistant", EXTRA_CHAT)],
        "conv_id long, turn long, role string, text string",
    )
    chats = chat.format_chats(turns.union(extra))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chats.withColumn("turns", chat.read_back(F.col("formatted")))
        .withColumn("learnt", chat.learnt_text(F.col("segments")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            sha256(F.array_join(said, "")).alias("turns_sha256"),
            F.char_length("learnt").cast("long").alias("loss_chars"),
            sha256(F.col("learnt")).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "state",
            "valid",
        )
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(table(spark, sf_dir, "documents"), n_shingles=4, least=85)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labels of rows that are not held out, and on those documents only."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"),
        toxicity.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), ids=False)
    return packed.withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda doc_id: F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))
    model = katz.fit(docs, learn=~held_out(F.col("doc_id")))
    return katz.score_own(model).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.known.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_fingerprints": op5_fingerprints,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_whitening": op13_whitening,
}
