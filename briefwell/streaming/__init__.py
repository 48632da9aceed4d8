"""Streaming forms: windows, incremental feedback, source history kept by micro-batches."""
