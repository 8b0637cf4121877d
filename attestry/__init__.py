"""Ownership and license notices in text collections, found and judged with Spark DataFrames."""
