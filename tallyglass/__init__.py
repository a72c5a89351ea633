"""Recognised documents to typed, scored records, as DataFrame transformations."""
