"""Structured Streaming jobs and their building blocks."""
