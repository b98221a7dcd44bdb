"""Functions over terms."""
