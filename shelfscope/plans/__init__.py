"""End-to-end runs that chain the operators and store their results."""
