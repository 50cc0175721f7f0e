"""Stateful and event-time operators for Structured Streaming; all run on batch frames' schemas, too."""
