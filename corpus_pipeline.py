"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing to target weights, best-fit packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, langid, mixing, ngram_join, packing
from lodestar.llm.common import stored
from lodestar.llm.queries import tokenizer_path

#: Columns of documents: what each stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark, docs, sf_dir):
    """Drops null texts and those without a letter, which have no language; a null lang becomes the predicted one. Where no row has
    a lang there is nothing to learn from: texts with a letter stay, their lang null. Repeated rows each stay."""
    model = langid.train(docs)
    if model is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike("\\p{L}"))
    found = langid.identify(docs, model, columns=COLUMNS).where(F.col("lang_pred") != "und")
    lang = F.coalesce("in_lang", "lang_pred").alias("lang")
    return found.select("doc_id", *(lang if c == "lang" else F.col(f"in_{c}").alias(c) for c in COLUMNS[1:]))


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts, null counting as empty, the row with the smallest id stays, and of repeated rows one."""
    return exact_dedup.without_copies(docs, COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of documents joined by 5-word shingle similarity of 0.8 or more, the one with the smallest id stays: all of
    its rows, should the id have several texts. Documents without words stay, as do rows without an id that have no other in
    their group."""
    kept = ngram_join.ngram_components(docs, k=5, num=80, den=100).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    docs = docs.select(*COLUMNS)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def mix_to_targets(spark, docs, sf_dir):
    """Samples documents so that sources, languages and topics meet their target shares of tokens."""
    taken = mixing.mix_sources(docs).where("selected").select(F.col("doc_id").alias("taken_id"))
    docs = docs.select(*COLUMNS)
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"]), "left_semi")


def pack_sequences(spark, docs, sf_dir):
    """Packs the pieces of what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_duplicates", drop_near_copies), ("mixing", mix_to_targets), ("packing", pack_sequences)]

#: The first stage's model and the fourth's iterated weights are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents in turn; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
