"""Heliograph plans."""
