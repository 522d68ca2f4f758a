"""Names, labels and counterparties out of free text."""
from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _col, strip

# Legal forms removed from an upper-case company name, in this order.
LEGAL_FORMS = (
    r"\bS\s*A\s*U\b", r"\bS\s*A\b", r"\bS\s*L\s*U\b", r"\bS\s*L\b",
    r"\bB\s*V\b", r"\bN\s*V\b", r"\bS\s*A\s*R\s*L\b", r"\bS\s*C\s*A\b",
    r"\bC\s*B\b", r"\bCO\s*LTD\b", r"\bCO\s*LIMITED\b", r"\bLTD\b", r"\bLIMITED\b",
)

# Where a transfer text names the counterparty, in order of preference.
COMPANY_PATTERNS = (
    r"(?i)TRANSFERENCIA DE\s+([^,]+)",
    r"(?i)/PT/FT/BO/([^/]+)",
    r"(?i)/BO/([^/]+)",
    r"(?i)^([^/]+)/",
)


def _base_letter(ch: str) -> str:
    """The letter that a code point decomposes to, with all its marks left out."""
    parts = unicodedata.decomposition(ch)
    while parts and not parts.startswith("<"):
        ch = chr(int(parts.split()[0], 16))
        parts = unicodedata.decomposition(ch)
    return ch


# Letters whose canonical decomposition starts with A-Z, and that letter, for upper-case text.
_DECOMPOSED = {chr(i): _base_letter(chr(i)) for i in range(0xC0, 0x2000) if unicodedata.decomposition(chr(i))}
_ACCENTED = "".join(c for c, base in _DECOMPOSED.items() if "A" <= base <= "Z" and len(base) == 1)
_BASE = "".join(_DECOMPOSED[c] for c in _ACCENTED)

NO_COMPANY = "NO_COMPANY"


def once(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_text(c: Column | str) -> Column:
    # Text of one-byte letters has no marks to take off.
    bare = lambda upper: F.when(F.octet_length(upper) == F.char_length(upper), upper).otherwise(
        F.regexp_replace(F.translate(upper, _ACCENTED, _BASE), r"\p{Mn}", ""))
    words = F.trim(F.regexp_replace(once(F.upper(strip(c)), bare), r"[^A-Z0-9]+", " "))
    return once(words, blank_to_null)


def _without_forms(forms: list[str], last: str):
    """Takes legal forms that end in one letter out of the blank-padded words of a name.

    Most names have no word that ends in it and need no pattern search.
    """

    def out(name: Column) -> Column:
        left = name
        for form in forms:
            left = F.regexp_replace(left, form, " ")
        return F.when(name.contains(f"{last} "), left).otherwise(name)

    return out


def normalize_company(c: Column | str, spaced_digits: bool = True) -> Column:
    """Company name without legal forms; null for numbers and incoming-transfer texts.

    ``spaced_digits`` also rejects names whose first nine characters are digits with blanks.
    """
    name = F.concat(F.lit(" "), normalize_text(c), F.lit(" "))
    for last, forms in groupby(LEGAL_FORMS, key=lambda form: form[-3]):  # in their order
        name = once(name, _without_forms(list(forms), last))
    name = F.trim(F.regexp_replace(name, r"\s+", " "))

    def kept(name: Column) -> Column:
        head = F.trim(F.substring(name, 1, 9))
        bad = (
            (name == "")
            | name.rlike(r"^\d+$")
            | head.rlike(r"^(\d\s*)+$" if spaced_digits else r"^\d+$")
            | name.startswith("INCOMING")
        )
        return F.when(~bad, name)

    return once(name, kept)


def extract_company(c: Column | str) -> Column:
    usable = lambda part: F.when((part != "") & ~part.rlike(r"^\d+$"), part)
    return once(strip(c), lambda text: F.coalesce(*[once(strip(F.regexp_extract(text, p, 1)), usable) for p in COMPANY_PATTERNS]))


def first_non_empty_text(*columns: Column | str) -> Column:
    return F.coalesce(*[once(strip(c), blank_to_null) for c in columns])


def sanitize_label(c: Column | str, max_len: int = 80) -> Column:
    label = F.regexp_replace(normalize_text(c), " ", "_")
    return F.substring(F.coalesce(label, F.lit("UNKNOWN")), 1, max_len)


def simple_company_name(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(_col(c))), r"\s+", " ")
