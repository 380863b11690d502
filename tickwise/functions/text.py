"""Text column expressions.

Java regex differs from Python's ``re``: ``\\w \\s \\d`` are ASCII unless
``(?U)`` is given, ``$`` also matches before a final newline (``\\z`` is
exact) and ``\\R`` is not ``str.splitlines``.  The helpers below pin the
Python semantics down explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip()/str.isspace() treat as whitespace.
PY_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same set as literal characters (for btrim, which needs no regex).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
# Line boundaries of Python's str.splitlines() (after CRLF has been folded to LF).
PY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_LINE_BREAK_CLASS = r"[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace (no regex)."""
    return F.btrim(c, F.lit(PY_WS_CHARS))


def py_lines(c: Column) -> Column:
    """Python ``str.splitlines()`` as an array (no trailing empty line).

    CRLF is folded by a literal replace, then one split on a single character
    class; a trailing empty element (text ending in a break, or empty text) is
    dropped, as ``splitlines`` does.
    """
    parts = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), _LINE_BREAK_CLASS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
