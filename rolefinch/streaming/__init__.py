"""Change tracking as a stream."""
