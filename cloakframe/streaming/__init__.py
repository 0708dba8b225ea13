"""Structured Streaming: batches with a vault commit, and re-chunked text by keyed state."""
