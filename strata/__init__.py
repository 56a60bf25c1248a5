"""Strata: deep-time analytics over fossil occurrences on Spark."""
