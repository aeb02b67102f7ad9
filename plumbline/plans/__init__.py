"""Whole runs: operators put together."""
