"""Lattika streaming."""
