"""Document-extraction analytics expressed as Spark plans."""
