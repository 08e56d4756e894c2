"""Review analytics on Spark: enrichment, rollups, feeds, label curation, evaluation."""
