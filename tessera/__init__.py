"""Batch-first retrieval, evidence and knowledge-graph analytics on Spark DataFrames."""
