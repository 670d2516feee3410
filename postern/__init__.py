"""Explainable triage of suspicious mail on Spark, and (in `llm`, optional) training-data operators."""

__version__ = "0.2.0"
