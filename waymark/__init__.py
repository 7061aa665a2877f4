"""Mobility trajectory analytics on Spark."""
