"""Heliograph operators."""
