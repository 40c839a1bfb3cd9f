"""Robust routing analytics and corpus preparation on Spark."""
