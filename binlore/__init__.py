"""A Spark-first engine for the artefacts of compiled programs and for text corpora."""
