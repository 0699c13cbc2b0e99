"""Reading rows and keys, and storing sketches and results."""
