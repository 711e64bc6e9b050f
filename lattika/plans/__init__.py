"""Lattika plans."""
