"""Reading wide survey tables, codebooks, and the long answers snapshot."""
