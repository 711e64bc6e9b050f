"""Lattika operators."""
