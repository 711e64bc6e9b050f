"""Lattika: a Spark-native engine for weighted, multi-level lattice data."""
