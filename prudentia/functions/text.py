"""Text clean-up, account codes and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prudentia.constants import (
    INCOME_ORDER,
    INCOME_ORDER_OTHER,
    LEGAL_SUFFIXES,
    PERCENT_LINE_PATTERN,
    REGULATORY_SUFFIXES,
)

# SQL trim removes only blanks; filings also carry tabs, NBSP and control separators.
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return F.trim(text, F.lit(_BLANKS))


def parse_number(text: Column) -> Column:
    """``7.043.370,57`` to 7043370.57; NULL where the text is no number."""
    return F.translate(text, ",.", ".").try_cast("double")


def dotted_account(code: Column) -> Column:
    """Eight digits to the dotted form: ``71100001`` to ``7.1.1.00.00-1``."""
    levels = [F.substring(code, start, size) for start, size in ((1, 1), (2, 1), (3, 1), (4, 2), (6, 2))]
    return F.concat(F.concat_ws(".", *levels), F.lit("-"), F.substring(code, 8, 1))


def cnpj8(cnpj: Column) -> Column:
    """Root of a tax id: its first eight characters."""
    return F.substring(cnpj, 1, 8)


def account_stem(account: Column) -> Column:
    """Account without its ``-d`` check digit."""
    return F.left(account, F.length(account) - 2)


def zero_digit_account(account: Column) -> Column:
    """The account as filed when every check digit was written ``0``."""
    return F.concat(account_stem(account), F.lit("-0"))


def _drop_one_suffix(text: Column, suffixes: tuple[str, ...]) -> Column:
    choices = "|".join(re.escape(s) for s in suffixes)
    return F.regexp_replace(text, rf"(?iu)(?:{choices})\z", "")


def commercial_name(name: Column) -> Column:
    """Name without one regulatory and then one legal-form suffix."""
    shorter = _drop_one_suffix(name, REGULATORY_SUFFIXES)
    return strip(_drop_one_suffix(shorter, LEGAL_SUFFIXES))


def is_percent_line(line_name: Column) -> Column:
    """True for lines filed as fractions and shown as percentages."""
    return line_name.rlike(PERCENT_LINE_PATTERN)


def income_order(account: Column) -> Column:
    """Display position: by full label, else by account group, else last."""
    entries = [F.lit(x) for pair in INCOME_ORDER.items() for x in pair]
    positions = F.create_map(*entries)
    return F.coalesce(
        F.try_element_at(positions, account),
        F.try_element_at(positions, F.left(account, F.lit(3))),
        F.lit(INCOME_ORDER_OTHER),
    )


def like_sql(column: str, pattern: str) -> str:
    """LIKE as SQL text, with cheap substring tests first.

    ``%a%b%`` runs a regex per row; testing the literal pieces beforehand lets
    nearly all rows fail on a byte search instead. A pattern with one piece is
    already turned into a prefix, suffix or contains test by Catalyst.
    """
    pieces = sorted((p for p in re.split("[%_]", pattern) if p), key=len, reverse=True)
    tests = [f"contains({column}, '{p}')" for p in pieces] if len(pieces) > 1 else []
    return " and ".join([*tests, f"{column} like '{pattern}'"])
