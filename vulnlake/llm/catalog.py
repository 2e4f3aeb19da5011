"""Importing this module registers every query of the package."""

from vulnlake.llm import fingerprints, merkle, mixing, near_dedup, packing, prefix_trie, quality, surrogates, token_counts, toxicity, url_filter, warc, wavelet  # noqa: F401
from vulnlake.llm.registry import ORACLES, QUERIES, query



@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES"]
