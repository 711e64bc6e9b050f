"""Lattika functions."""
