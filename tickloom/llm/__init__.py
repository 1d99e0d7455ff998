"""Operators for training-data pipelines, written for Spark."""
