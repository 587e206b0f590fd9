"""attesta: evidence and acceptance analytics expressed as Spark DataFrame plans."""
