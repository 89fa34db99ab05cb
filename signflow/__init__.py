"""Signed causal-graph analytics on PySpark."""
