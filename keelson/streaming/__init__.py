"""Ingest: bounded queues with group commit, and streams that end in a store."""
