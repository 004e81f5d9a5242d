"""Contest analytics expressed as Spark DataFrame plans."""
