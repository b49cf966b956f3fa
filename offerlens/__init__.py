"""Offer analytics on Spark: parse, normalize, classify, de-duplicate and query retail offers."""
