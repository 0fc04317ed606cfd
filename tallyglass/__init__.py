"""Disclosure audit jobs on Spark."""
