"""Structured Streaming forms of the sampled and time-based operators, each with a batch twin."""
