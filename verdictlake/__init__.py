"""Eligibility-rules analytics and document operators for Spark."""
