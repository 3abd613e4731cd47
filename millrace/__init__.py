"""Spark-first preparation and scoring of biomedical text, trial and patient data."""

__version__ = "0.1.0"
