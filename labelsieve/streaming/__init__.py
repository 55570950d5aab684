"""Live frames as a stateful stream."""
