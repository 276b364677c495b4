"""Sedimark: evidence analytics and corpus preparation on Spark."""
