"""Column functions on text and costs."""
