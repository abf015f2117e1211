"""Part of the candidate analytics."""
