"""Document screening on Spark: DataFrame and streaming operators."""
