"""Statistics and sketches of streams."""
