"""Utility meters: batch jobs over the pulse log and their Structured Streaming forms."""
