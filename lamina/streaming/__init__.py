"""Resumable micro-batches."""
