"""Heliograph sources."""
