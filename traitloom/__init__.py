"""A Spark-first engine for image-trait tables."""
