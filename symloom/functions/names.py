"""Names, identities and paths.

Identities are ``module::name``, or the name alone where the module is empty.
Each function over columns has a counterpart over str for the point queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "::"


def identity(module: Column, name: Column) -> Column:
    return F.when(module == "", name).otherwise(F.concat(module, F.lit(SEPARATOR), name))


def last_segment(path: Column, separator: str = SEPARATOR) -> Column:
    """What follows the last separator, or all of it."""
    return F.substring_index(path, separator, -1)


def leading_segments(path: Column) -> Column:
    """What stands before the last ``::``; '' without one."""
    cut = F.length(path) - F.length(last_segment(path)) - len(SEPARATOR)
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def looks_like_path(text: Column) -> Column:
    """True for texts with a slash or a backslash, and for those with a file extension."""
    extension = text.rlike(r"(?s)^.+\.[^.]*$") & (text != "..")
    return text.contains("/") | text.contains("\\") | extension


def path_order(path: Column) -> Column:
    """A key that sorts paths by component instead of by byte: a separator comes before any character."""
    return F.translate(path, "/", "\x01")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def split_qualified(name: str) -> tuple[str, str] | None:
    """(module, symbol) of a qualified name; None without ``::`` or where either side is empty."""
    module, found, symbol = name.rpartition(SEPARATOR)
    return (module, symbol) if found and module and symbol else None


def symbol_target(name: str, module: str | None) -> tuple[str | None, str]:
    """(module, bare name) of a query; an explicit module wins over the one in a qualified name."""
    split = split_qualified(name)
    if module is not None:
        return module, split[1] if split else name
    return split if split else (None, name)
