"""Reusable plan shapes: running totals that survive hot keys, first-per-key."""
