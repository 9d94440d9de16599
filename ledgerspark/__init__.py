"""Transaction histories on Spark: features, tokens, samples and evaluation."""
