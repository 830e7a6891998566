"""Document analytics on Spark: ordered text, page geometry, quality rules and progress reports."""
