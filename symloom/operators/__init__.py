"""Relational operators over the fact tables; each works on all names at once."""
