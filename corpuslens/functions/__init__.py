"""Column functions and primitives over densely numbered rows."""
