"""Reusable plan shapes: bounded lookups, blocked windows, range buckets, salted joins, whole pipelines."""
