"""Text grid and survey sources, and the matching sinks."""
