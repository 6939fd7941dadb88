"""barlab.operators."""
