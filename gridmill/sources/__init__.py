"""File and payload readers, and table sinks."""
