"""Document and image analysis as Spark plans."""
