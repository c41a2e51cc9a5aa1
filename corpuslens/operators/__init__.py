"""Builders of the index tables, listing, frequencies and grammars."""
