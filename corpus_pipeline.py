"""Documents to packed sequences: language, toxicity, boilerplate lines, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.llm import binary_packing, line_dedup, ppm_language, simhash, toxicity
from gravure.llm.common import remainder, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs, sf_dir):
    """Documents in one of the languages of the corpus, `lang` set to the one that codes the text in the fewest bits.

    Learned from four fifths of the documents that have a lang, by hash of doc_id; the rest gives the usual code length
    per byte of each language. Out go texts that need over three times that and 256 bits more (see
    ppm_language.strange), and texts without any letter: nulls, empty ones, numbers. Where no lang is known, all texts
    with a letter stay as they are. Repeated rows are judged alike; all columns but COLUMNS are dropped; an empty table
    gives no rows; a very long text takes memory in proportion in one task.
    """
    fifth = remainder(F.col("doc_id"), 5)
    model = ppm_language.train(docs.where(fifth != 0)) or ppm_language.train(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}")).select(*COLUMNS)
    usual = ppm_language.usual_bits(docs.where(fifth == 0), model)
    known = ppm_language.identify(docs.select(*COLUMNS), model, COLUMNS)
    known = known.where((F.col("lang_pred") != ppm_language.UNKNOWN) & ~ppm_language.strange(usual))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def toxic(spark, docs, sf_dir):
    """Documents that a model of the labelled ones doesn't make out as toxic.

    Null and empty texts have no evidence and stay unless most labels are toxic; without labels all stay. Repeated
    rows are judged alike; all columns but COLUMNS are dropped; an empty table gives no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def lines(spark, docs, sf_dir):
    """All documents, each cross-site line once; n_chars follows the text.

    A text of boilerplate alone becomes empty; null texts stay null, with null n_chars; rows without a source count
    for no site; repeated rows are rows of their own, of which the first keeps the line; all columns but COLUMNS are
    dropped; an empty table gives no rows.
    """
    return line_dedup.drop_boilerplate(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar texts: that of the smallest id, rows without an id coming last.

    Such rows take part under a number from their text's hash. Equal rows become one, as they are copies; so do all
    texts without a word, nulls included; rows of one id and different texts stay or go with that id's group.
    All columns but COLUMNS are dropped; an empty table gives no rows.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 2) + F.lit(1 << 62))
    rows = docs.select(*COLUMNS).withColumn("number", number)
    groups = simhash.similar_documents(rows.select(F.col("number").alias("doc_id"), "text"), width=5, similarity=0.8)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    stay = rows.join(kept.withColumnRenamed("doc_id", "kept"), F.col("number") == F.col("kept"), "left_semi")
    return stay.dropDuplicates(["number", "text"]).select(*COLUMNS)


def packing(spark, docs, sf_dir):
    """Pieces of binary lengths with their ids; nulls, repeats, long texts and empty tables as in binary_packing.pack."""
    return binary_packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("line dedup", lines), ("near duplicates", near_duplicates), ("packing", packing)]
#: Models and fingerprints have no SQL form. The tests hold the language trees against plain dictionaries, near
#: duplicates against exact Jaccard and toxicity against labels and a plain Kneser-Ney model.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
