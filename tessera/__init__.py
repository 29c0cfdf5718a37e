"""Document analytics on Spark: cleaning, parsing, chunking, retrieval, fusion, evaluation."""
