"""Structured Streaming forms of the block operators."""
