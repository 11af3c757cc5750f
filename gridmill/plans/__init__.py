"""Step chains and preset chains built from operators."""
