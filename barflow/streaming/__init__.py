"""Structured Streaming jobs: live bars and latest quotes."""
