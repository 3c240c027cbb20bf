"""glyphstream: a Spark-first engine that treats documents as tables of Unicode-aware lines."""
