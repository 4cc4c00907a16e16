"""Structured Streaming: the batch operators on live input."""
