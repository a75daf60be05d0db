"""Whitespace handling with the exact character set of Python's ``str.strip`` and ``str.split``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java regular expression class.
SPACE_CLASS = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Runs that are not one space already. Visible ASCII is settled by one comparison a character.
_QUICK_SPACE = rf"[[^!-~]&&{SPACE_CLASS}]"
_UNEVEN_SPACE = rf"(?: {_QUICK_SPACE}|[[^ -~]&&{SPACE_CLASS}]){_QUICK_SPACE}*"


def strip(text: Column) -> Column:
    """Remove whitespace from both ends (SQL ``trim`` alone removes only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.btrim(F.regexp_replace(text, _UNEVEN_SPACE, " "))


def words(text: Column, lower: bool = False) -> Column:
    """Split on whitespace; no empty words."""
    text = F.lower(text) if lower else text
    return F.array_remove(F.split(squeeze(text), " "), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)
