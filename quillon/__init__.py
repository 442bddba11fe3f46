"""Quillon: product matching, price position and corpus preparation as Spark jobs."""
