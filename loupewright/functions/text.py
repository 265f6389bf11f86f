"""Text expressions: document numbers, file links, clock strings, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder host, and the picture shown when none is stored.
PICTURE_BASE = "https://pictures.example/"
DEFAULT_PICTURE = "avatar.png"


def trimmed_length(c: Column) -> Column:
    """Length that ignores trailing blanks."""
    return F.length(F.rtrim(c))


def key_text(c: Column) -> Column:
    """Key normalised for comparison: no trailing blanks, upper case."""
    return F.upper(F.rtrim(c))


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores trailing blanks and letter case."""
    return key_text(a) == key_text(b)


def concat_skip_null(*parts: Column) -> Column:
    """Concatenation that reads NULL as empty text; plain ``concat`` returns NULL instead."""
    return F.concat_ws("", *parts)


def picture_url(path: Column, base: str = PICTURE_BASE, default: str | None = None) -> Column:
    """Link for a stored drive path: drop the drive, turn the slashes, escape ``#``.

    With ``default`` set, an unset path yields the default picture instead of NULL.
    """
    relative = F.substring(path, F.lit(4), F.char_length(path))
    link = F.concat(F.lit(base), F.replace(F.replace(relative, F.lit("\\"), F.lit("/")), F.lit("#"), F.lit("%23")))
    if default is None:
        return link
    return F.when(path.isNull() | (path == ""), F.lit(base + default)).otherwise(link)


def clock_text(hhmmss: Column) -> Column:
    """``HHMMSS`` to ``HH:MM:SS``."""
    return F.concat_ws(":", F.left(hhmmss, F.lit(2)), F.substring(hhmmss, 3, 2), F.right(hhmmss, F.lit(2)))


def clock_digits(moment: Column) -> Column:
    """Timestamp to ``HHMMSS``."""
    return F.date_format(moment, "HHmmss")


def clock_minutes(moment: Column) -> Column:
    """Timestamp to ``HH:mm``."""
    return F.date_format(moment, "HH:mm")


def zero_pad(number: Column, width: int, cut: bool = False) -> Column:
    """A number with at least ``width`` digits, zero filled on the left.

    A number that needs more digits has more; with ``cut`` it loses the leading ones instead, so
    that different numbers can look alike.
    """
    digits = number.cast("string")
    if cut:
        return F.right(F.concat(F.lit("0" * width), digits), F.lit(width))
    return F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def display_name(first: Column, nick: Column) -> Column:
    """``first (nick)``, NULL when either is unknown."""
    return F.concat(first, F.lit(" ("), nick, F.lit(")"))
