"""lectern: exhaustive, intent-driven reading of large text corpora on Spark."""
