"""Belief logs on Spark: views, admission, commitments and audits as DataFrame jobs."""

__version__ = "0.1.0"
