"""tessel: a Spark-first engine for curating, checking and evaluating corpora and sequences."""

__version__ = "0.1.0"
