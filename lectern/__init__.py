"""Scholarly-corpus and membership analytics as DataFrame-to-DataFrame operators on Spark."""
