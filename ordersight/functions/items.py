"""Encoded item lists.

Shop exports store line, shipping and coupon items as text::

    items := item (';' item)*      item := field ('|' field)*      field := key ':' value

A field is split at its first ``:``; a field without ``:`` is ignored; when a key
repeats inside one item, the last value wins; a null text has no items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def records(text) -> Column:
    """The items of an encoded text as an array of item texts (null stays null)."""
    return F.split(as_col(text), ";")


def field(record, key: str) -> Column:
    """Value of ``key`` in one item text: last field starting with ``key:`` wins."""
    text, start = F.concat(F.lit("|"), as_col(record)), f"|{key}:"
    return F.when(F.contains(text, F.lit(start)), F.substring_index(F.substring_index(text, start, -1), "|", 1))


def slot_field(text, i: int, key: str) -> Column:
    """``{prefix}_{i}_{key}`` of the wide layout: field ``key`` of the i-th item (1-based)."""
    return field(F.try_element_at(records(text), F.lit(i)), key)


def to_number(c) -> Column:
    """Coerce text to a number; unparsable or missing values become 0."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))
