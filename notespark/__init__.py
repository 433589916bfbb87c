"""Note-corpus analytics as Spark DataFrame operators."""
