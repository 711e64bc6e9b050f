"""Lattika sources."""
