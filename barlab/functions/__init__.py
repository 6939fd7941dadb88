"""barlab.functions."""
