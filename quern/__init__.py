"""quern: versioned tensor-archive analytics expressed as Spark DataFrame plans."""
