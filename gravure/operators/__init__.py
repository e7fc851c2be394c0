"""Operators over pixels, metadata, markup, delivery logs and hashes."""
