"""Columns over text: tokens, document numbers, query lines, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space at which Python's str.split() breaks.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """The array of tokens of a text: split at Unicode white space, case and punctuation kept, no empty ones; null text, null array."""
    return F.array_remove(F.split(_col(text), WHITE_SPACE), "")


def document_number(path: Column | str) -> Column:
    """The integer file name of a path ``…/…/…/<n>.txt``; null for other paths."""
    found = F.regexp_extract(_col(path), r"/.*/.*/(.*)\.txt", 1)
    return F.when(F.regexp_like(found, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(found).cast("int"))


def query_id(line: Column | str) -> Column:
    """The id of a query line: its first word if there are two or more and it starts with Q, else ``*``; null on a blank line."""
    words = tokens(line)
    return F.when(F.size(words) >= 2, F.when(F.startswith(words[0], F.lit("Q")), words[0]).otherwise("*")).when(F.size(words) == 1, F.lit("*"))


def query_text(line: Column | str) -> Column:
    """The words of a query line behind its id, joined by single spaces."""
    words = tokens(line)
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))
    return F.array_join(F.when((F.size(words) >= 2) & F.startswith(words[0], F.lit("Q")), rest).otherwise(words), " ")


def has_prefix(term: Column | str, prefix: str) -> Column:
    return F.startswith(_col(term), F.lit(prefix))
