"""Folding, identifier text and search predicates."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetrail.functions.binding import let

# Romanian letters and what they fold to, position by position.
FOLD_FROM = "ăâîșşțţ"
FOLD_TO = "aaisstt"
# Fixed value: a valid stock-keeping unit.
SKU_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._/-]{0,127}$"

# The characters clients trim as white space.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fold(c: Column) -> Column:
    """Lower case, accents dropped, white space collapsed."""
    blanks = SPACES.replace(" ", "")
    plain = F.translate(F.lower(c), FOLD_FROM + blanks, FOLD_TO + " " * len(blanks))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


@functools.cache
def _accented() -> tuple[str, str]:
    """Letters of every script that decompose into one bare letter and marks, and those bare letters."""
    pairs = []
    for code in [*range(0xC0, 0xD800), *range(0xE000, 0x110000)]:
        letter = chr(code)
        if not unicodedata.decomposition(letter):
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if bare != letter and len(bare) == 1:
            pairs.append((letter, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Accent-free lower case, as needed to read month names and fixed phrases."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), *_accented())


def search_text(name: Column, sku: Column, barcode: Column, brand: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (name, sku, barcode, brand)]
    return fold(F.concat_ws(" ", *parts))


# A number in exponent form or a control character is no identifier; the units of a quantity.
NOT_IDENTIFIER = r"[\x00-\x1f]|^\d+(?:\.\d+)?[eE][+-]?\d+$"
QUANTITY = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:kg|g|ml|l|buc)\b"


def identifier_text(c: Column) -> Column:
    """Text identifier as struct(value, error); leading zeros stay."""

    def judged(text: Column) -> Column:
        return let(identifier_fault(text), lambda f: F.struct(F.when(f.isNull(), text).alias("value"), f.alias("error")))

    return let(strip(c), lambda text: let(without_point(text), judged))


def without_point(text: Column) -> Column:
    """A whole number that was written with a point and zeros, without them."""
    return F.when(text.endswith("0"), F.regexp_replace(text, r"^(\d+)\.0+$", "$1")).otherwise(text)


def identifier_fault(text: Column) -> Column:
    """What is wrong with a stripped text as identifier, or null."""
    return F.when(text.isNull() | (text == ""), "empty identifier").when(text.rlike(NOT_IDENTIFIER), "invalid identifier text")


def identifier_number(c: Column, mask: Column | None = None) -> Column:
    """Numeric identifier as struct(value, error): integral, not negative, below 1e15."""
    number = c.cast("double")
    safe = ~F.isnan(number) & (number >= 0) & (number < F.lit(1e15)) & (F.floor(number) == number)
    text = F.when(safe, number).cast("decimal(20,0)").cast("string")
    if mask is not None:
        text = F.when(mask.rlike("^0+$"), zero_mask(text, F.length(mask))).otherwise(text)
    return F.struct(
        F.when(safe, text).alias("value"),
        F.when(c.isNull(), "empty identifier")
        .when(~safe, "unsafe numeric identifier")
        .alias("error"),
    )


def zero_mask(c: Column, width: Column | int) -> Column:
    """Left-pad with zeros and never cut (lpad alone would)."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(c, F.greatest(F.length(c), width), F.lit("0"))


def missing_sku(c: Column) -> Column:
    return is_blank(c)


def valid_sku(c: Column) -> Column:
    return F.coalesce(c.rlike(SKU_PATTERN), F.lit(False))


def contains_literal(c: Column, query: Column | str) -> Column:
    """Substring test in which %, _ and backslash stand for themselves."""
    return c.contains(F.lit(query) if isinstance(query, str) else query)


def quantity_of(name: Column) -> Column:
    """First measure in a product name, e.g. '500 g'; null when there is none."""
    found = F.regexp_extract(name, QUANTITY, 0)
    return F.when(found != "", found)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, the order key of name listings."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
