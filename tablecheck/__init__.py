"""tablecheck: Spark-native loading, materialising and grading of ELT pipeline runs."""

__version__ = "0.1.0"
