"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, kmeans, linededup, lm, neardup, oracles, pii, quality, recompress, suffix, tokengroups, urls
from .common import table


def op1_line_dedup(spark, sf_dir):
    return linededup.digests(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_substring(spark, sf_dir):
    return recompress.digests(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix(spark, sf_dir):
    return suffix.digests(table(spark, sf_dir, "documents"))


def op6_lm(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.digests(table(spark, sf_dir, "documents"))


def op8_urls(spark, sf_dir):
    """The list stands in for a published one: the URLs of the pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages")
    return urls.verdicts(pages, pages.where(F.col("page_id") % 100 == 0).select("url")).drop("maybe")


def op9_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_minhash(spark, sf_dir):
    return neardup.digests(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark, sf_dir):
    return tokengroups.digests(table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark, sf_dir):
    return kmeans.clusters(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark, sf_dir):
    return alignment.alignments(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_line_dedup, op2_pii, op3_substring, op4_decontamination, op5_suffix, op6_lm, op7_quality, op8_urls, op9_bpe, op10_minhash, op11_jaccard_join, op12_ball_kmeans, op13_alignment)}


def oracle_sql():
    return {"op3_substring": oracles.SUBSTRING, "op4_decontamination": oracles.DECONTAMINATION, "op7_quality": oracles.QUALITY, "op8_urls": oracles.URLS, "op10_minhash": oracles.NEAR, "op11_jaccard_join": oracles.SIMILAR, "op12_ball_kmeans": oracles.CLUSTERS}
