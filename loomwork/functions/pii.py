"""Detection and masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each kind looks like, bounded by non-digits. RE2 and Java read them alike.
PATTERNS = {
    "phone": r"(?:^|[^0-9+])((?:\+7|8)[ (-]*[0-9]{3}[ )-]*[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2})(?:[^0-9]|$)",
    "passport_ru": r"(?:^|[^0-9])([0-9]{2} [0-9]{2} [0-9]{6})(?:[^0-9]|$)",
    "snils": r"(?:^|[^0-9])([0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2})(?:[^0-9]|$)",
    "oms": r"(?:^|[^0-9])([0-9]{16})(?:[^0-9]|$)",
    "inn": r"(?:^|[^0-9])([0-9]{12}|[0-9]{10})(?:[^0-9]|$)",
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
}


def reasons(text: Column) -> Column:
    """Names of the kinds found, in a fixed order. Texts that lack what all kinds of numbers hold, two digits in a row, or the sign of an address are not searched for them."""
    t = F.coalesce(text, F.lit(""))
    numbers = F.array(*(F.when(t.rlike(p), name) for name, p in PATTERNS.items() if name != "email"))
    none = F.array().cast("array<string>")
    address = F.array(F.when(t.contains("@") & t.rlike(PATTERNS["email"]), "email"))
    return F.array_compact(F.concat(F.when(t.rlike("[0-9]{2}"), numbers).otherwise(none), address))


def masked(text: Column, sign: str = "***") -> Column:
    """The text with e-mail addresses and runs of 10 or more digits (with separators) replaced."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", sign)
    return F.regexp_replace(t, r"[+]?[0-9](?:[ ()-]{0,2}[0-9]){9,15}", sign)
