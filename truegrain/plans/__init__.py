"""Whole runs and their reports."""
