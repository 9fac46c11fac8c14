"""Sketches and user functions."""
