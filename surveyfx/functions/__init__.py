"""Column-level building blocks: recodes and distribution functions."""
