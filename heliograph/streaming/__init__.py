"""Heliograph streaming."""
