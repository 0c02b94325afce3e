"""Structured Streaming: framed pitch tracking."""
