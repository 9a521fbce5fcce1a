"""Catalog and erasure-coding analytics on Spark."""
