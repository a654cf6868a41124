"""Facts from source texts: one scanner for each language, one pass over each file."""

from symloom.sources.extract.registry import Facts, Language, Registry, default_registry

__all__ = ["Facts", "Language", "Registry", "default_registry"]
