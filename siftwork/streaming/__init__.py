"""Structured Streaming: scoring arriving texts and collecting label events."""
