"""Reads, runs, compaction, integrity and the sketch registry."""
