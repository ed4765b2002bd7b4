"""Scans: each returns a DataFrame with an explicit schema."""
