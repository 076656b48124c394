"""Spark-first engine for adjudicating pools of candidate queries and their results."""
