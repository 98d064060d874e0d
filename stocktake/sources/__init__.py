"""Source trees, run histories and their sinks."""
