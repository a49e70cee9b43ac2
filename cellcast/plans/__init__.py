"""End-to-end flows built from the operators."""
