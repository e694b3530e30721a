"""Structured Streaming: see ``windows``."""
