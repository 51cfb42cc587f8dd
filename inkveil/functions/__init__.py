"""See the README for this part of the engine."""
