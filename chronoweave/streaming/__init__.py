"""Streaming twins of the batch windows."""
