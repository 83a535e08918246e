"""Text cleaning rules for contact fields.

Each function maps columns to a column with built-in expressions only, so the
whole cleaning step is one projection inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups as L
from ._util import as_col


def strip(c) -> Column:
    """Remove leading and trailing whitespace (tabs and newlines too, like ``str.strip``)."""
    return F.btrim(as_col(c), F.lit(" \t\n\x0b\f\r"))


# --------------------------------------------------------------- phone

def standardize_phone(c) -> Column:
    """Digits only; 10 digits, or 11 starting with 1, become ``+1 (AAA) BBB-CCCC``.

    A missing phone gives the empty text.
    """
    d = F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")), "[^0-9]", "")

    def fmt(off: int) -> Column:
        return F.concat(F.lit("+1 ("), F.substring(d, off + 1, 3), F.lit(") "),
                        F.substring(d, off + 4, 3), F.lit("-"), F.substring(d, off + 7, 4))

    return (F.when(F.length(d) == 10, fmt(0))
            .when((F.length(d) == 11) & d.startswith("1"), fmt(1))
            .otherwise(d))


def area_code(c) -> Column:
    """The three digits inside ``(...)`` of a phone, else ``UNKNOWN``."""
    p = as_col(c)
    code = F.regexp_extract(p, r"\((\d{3})\)", 1)
    return F.when(p.isNull() | (code == ""), F.lit("UNKNOWN")).otherwise(code)


def blank_unknown(c) -> Column:
    """``UNKNOWN`` becomes the empty text."""
    return F.when(as_col(c) == "UNKNOWN", F.lit("")).otherwise(as_col(c))


# ------------------------------------------------------ postcode, state

def zip_main(c) -> Column:
    """Part of a trimmed postcode before the first ``-`` (the whole text without ``-``)."""
    return F.substring_index(strip(c), "-", 1)


def zip_extra(c) -> Column:
    """First four characters after the first ``-``, null without ``-``."""
    p = strip(c)
    rest = F.substring(p, F.instr(p, "-") + 1, 1 << 30)
    return F.when(F.instr(p, "-") > 0, F.substring(rest, 1, 4))


def zip5(c) -> Column:
    """First five characters of the raw postcode: the census join key."""
    return F.substring(as_col(c), 1, 5)


def state_code(c) -> Column:
    """Two-letter code of a state name; other text is upper-cased as it is.

    The 52-entry map is a literal inside the expression: no join, no shuffle.
    """
    states = F.create_map(*[F.lit(x) for x in chain.from_iterable(L.STATE_CODES.items())])
    key = F.lower(strip(c))
    return F.upper(F.coalesce(F.try_element_at(states, key), key))


# ------------------------------------------------------------- email

def email_domain(c) -> Column:
    """Text between the first and second ``@``; ``UNKNOWN`` when null or without ``@``."""
    return F.coalesce(F.try_element_at(F.split(as_col(c), "@"), F.lit(2)), F.lit("UNKNOWN"))


def email_category(domain) -> Column:
    """UNKNOWN / EDUCATION / PERSONAL / CORPORATE / OTHER, tested in this order (X11)."""
    d = as_col(domain)

    def ends(sfx):
        cond = F.lit(False)
        for s in sfx:
            cond = cond | d.endswith(s)
        return cond

    return (F.when(d == "UNKNOWN", "UNKNOWN")
            .when(ends(L.EDUCATION_SUFFIXES), "EDUCATION")
            .when(d.isin(L.PERSONAL_EMAIL_HOSTS), "PERSONAL")
            .when(ends(L.CORPORATE_SUFFIXES), "CORPORATE")
            .otherwise("OTHER"))


# ---------------------------------------------------------- company

def has_company(c) -> Column:
    """Company text present and not blank."""
    return as_col(c).isNotNull() & (strip(c) != "")


def company_category(c) -> Column:
    """UNKNOWN / RETIREMENT / PERSONAL / BUSINESS."""
    low = F.lower(as_col(c))

    def has_any(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        return cond

    return (F.when(as_col(c).isNull() | F.lower(strip(c)).isin(L.COMPANY_UNKNOWN_WORDS), "UNKNOWN")
            .when(has_any(L.COMPANY_RETIRED_WORDS), "RETIREMENT")
            .when(has_any(L.COMPANY_PERSONAL_WORDS), "PERSONAL")
            .otherwise("BUSINESS"))


# ---------------------------------------------------------- person keys

def customer_identifier(first, last, zip_main_col) -> Column:
    """``lower(first)_lower(last)_zip``; null when a name is null."""
    return F.concat(F.lower(as_col(first)), F.lit("_"), F.lower(as_col(last)), F.lit("_"),
                    F.coalesce(as_col(zip_main_col), F.lit("nan")))


def person_key(first, last, zip_main_col) -> Column:
    """``first last zip``, each trimmed and lower case; null when a name is null."""
    return F.concat(F.lower(strip(first)), F.lit(" "), F.lower(strip(last)), F.lit(" "),
                    F.lower(F.coalesce(as_col(zip_main_col), F.lit(""))))


# ------------------------------------------------------------ census

def income(c) -> Column:
    """Income estimate: drop ``, + - N``; blank or unparsable -> null."""
    t = F.regexp_replace(as_col(c), L.INCOME_STRIP_PATTERN, "")
    return F.when(t != "", t).try_cast("double")


def income_censored(moe_median, moe_mean) -> Column:
    """Either margin of error is ``***``."""
    return (F.coalesce(as_col(moe_median) == L.CENSORED_MARGIN, F.lit(False))
            | F.coalesce(as_col(moe_mean) == L.CENSORED_MARGIN, F.lit(False)))


def margin(c) -> Column:
    """Margin of error: census symbols -> null, commas removed, to number."""
    m = as_col(c)
    return F.when(m.isin(L.MARGIN_NULL_SYMBOLS), F.lit(None)).otherwise(
        F.regexp_replace(m, ",", "").try_cast("double"))


# ------------------------------------------------------------- flags

def used_coupon(coupon_1_id) -> Column:
    """1 when the first coupon has a non-blank id."""
    c = as_col(coupon_1_id)
    return F.when(c.isNotNull() & (c != ""), 1).otherwise(0)


def gender_binary(g) -> Column:
    """M -> 1, F -> 0, anything else null."""
    g = as_col(g)
    return F.when(g == "M", 1).when(g == "F", 0)


def name_key(c) -> Column:
    """Name-table key: trimmed, lower case."""
    return F.lower(strip(c))


def yes_no(prob, threshold: float = L.RETURN_THRESHOLD) -> Column:
    """``Yes`` when the probability reaches the threshold."""
    return F.when(as_col(prob) >= F.lit(threshold), "Yes").otherwise("No")
