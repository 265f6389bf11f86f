"""Table loading, session settings and sinks."""
