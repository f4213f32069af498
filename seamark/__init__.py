"""A Spark engine for chunking, indexing and hybrid search over text and source trees."""
