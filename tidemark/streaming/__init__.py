"""Structured Streaming: run progress, scans of arriving documents, event monitors."""
