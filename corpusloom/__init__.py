"""corpusloom: a Spark-first engine for building, auditing and measuring text corpora."""

__version__ = "0.1.0"
