"""Operators of a training-data pipeline; ``storyloom.llm.plans`` registers their queries."""
