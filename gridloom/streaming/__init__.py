"""Structured Streaming: arriving packages and windows over events."""
