"""The corpus operators over the given tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.llm import additive_quality, binary_packing, fit_packing, imatch, line_dedup, piece_bpe, ppm_language, resampling, simhash, spelling, tile_embeddings, token_counts, toxicity
from gravure.llm.common import remainder, table


def op1_imatch(spark, sf_dir):
    """I-Match fingerprints of all documents, of their edited texts, and how alike they are."""
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    """All documents without repeated lines that stand on ten sources or more."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "lines_removed")


def op3_token_counts(spark, sf_dir):
    """Token counts of all documents, through a digest cache that this run starts."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.new_cache(spark))


def op4_fit_packing(spark, sf_dir):
    """All documents in packed rows of 4096 ids."""
    return fit_packing.pack(table(spark, sf_dir, "documents"))


def op5_ppm_language(spark, sf_dir):
    """Languages of all documents, learned from those whose crc32 modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = ppm_language.train(ppm_language.training_part(docs))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return ppm_language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_simhash(spark, sf_dir):
    """Fingerprints of three-word shingles of all documents and their components within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op7_piece_bpe(spark, sf_dir):
    """All documents encoded by byte-level ranks and decoded again."""
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op8_tile_embeddings(spark, sf_dir):
    """All embeddings' links of a cosine of 0.95 or more."""
    return tile_embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op9_binary_packing(spark, sf_dir):
    """All documents cut into pieces of binary lengths."""
    return binary_packing.pack(table(spark, sf_dir, "documents"), ids=False)


def op10_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from labelled ones whose crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_part(docs), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_resampling(spark, sf_dir):
    """A tenth of all documents with 20 words or more, drawn to resemble the benchmark texts, with ranks."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_additive_quality(spark, sf_dir):
    """Quality of all documents, learned from labelled ones whose crc32 modulo 4 is not 2."""
    rated = additive_quality.rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), additive_quality.learning_ids())
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_spelling(spark, sf_dir):
    """Words of all documents with their near words, forms and roots."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_imatch, op2_line_dedup, op3_token_counts, op4_fit_packing, op5_ppm_language,
        op6_simhash, op7_piece_bpe, op8_tile_embeddings, op9_binary_packing, op10_toxicity, op11_resampling, op12_additive_quality, op13_spelling, pipeline,
    )
}
ORACLES = {"op2_line_dedup": line_dedup.SQL, "op11_resampling": resampling.SQL, "op13_spelling": spelling.SQL}
