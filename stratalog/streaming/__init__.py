"""Streaming forms of the log's state and of admission."""
