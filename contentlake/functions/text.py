"""Column functions over names and texts. ASCII rules follow the C locale: bytes >= 0x80 are never
letters, digits or spaces, and only A-Z fold to lower case."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Markers of a season or episode number.
SEASON_MARK = r"(?:s[0-9]+|season\s*[0-9]+|series\s*[0-9]+|episode\s*[0-9]+|ep\s*[0-9]+)"
# Fixed value: a year between 1900 and 2099.
YEAR = r"(?:19|20)[0-9]{2}"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain-ASCII rows take the vectorised path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def norm_separators(text: Column) -> Column:
    return F.translate(text, "._", "  ")


def drop_brackets(text: Column, passes: int = 4) -> Column:
    """Remove ``[...]`` with nesting. A stray ``]`` stays; an unclosed ``[`` drops the rest.

    Each pass removes the innermost pairs. Texts nested deeper than ``passes`` go through an
    exact character fold, so no depth is cut short.
    """
    reduced = text
    for _ in range(passes):
        reduced = F.regexp_replace(reduced, r"\[[^\[\]]*\]", "")
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(acc: Column, ch: Column) -> Column:
        closing = (ch == "]") & (acc["depth"] > 0)
        hidden = (ch == "[") | (acc["depth"] > 0)
        return F.struct(
            F.when(ch == "[", acc["depth"] + 1)
            .when(closing, acc["depth"] - 1)
            .otherwise(acc["depth"])
            .alias("depth"),
            F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], ch)).alias("kept"),
        )

    folded = F.aggregate(F.split(text, ""), state, step, lambda acc: acc["kept"])
    return (
        F.when(~F.contains(text, F.lit("[")), text)
        .when(F.regexp_like(reduced, F.lit(r"\[[^\[\]]*\]")), folded)
        .otherwise(F.regexp_replace(reduced, r"(?s)\[.*$", ""))
    )


def keep_year_parens(text: Column) -> Column:
    """``(...)`` is removed, except that a year is kept as ``year `` ; an unmatched ``(`` stays."""
    no_tags = F.regexp_replace(text, rf"\((?!\s*{YEAR}\s*\))[^)]*\)", "")
    return F.regexp_replace(no_tags, rf"\(\s*({YEAR})\s*\)", "$1 ")


def cut_at_season(text: Column) -> Column:
    """Cut at the first season or episode mark, unless the text starts with one."""
    at_start = F.regexp_like(text, F.lit(rf"(?i)^[^a-z]?{SEASON_MARK}"))
    return F.when(at_start, text).otherwise(
        F.regexp_replace(text, rf"(?is)^(.+?)[^a-z]{SEASON_MARK}.*$", "$1")
    )


def _strip_one(text: str, keywords: Sequence[str], fold: dict[int, int]) -> str:
    lowered = text.translate(fold)
    for word in keywords:
        size = len(word)
        at = lowered.find(word)
        while at >= 0:
            before, after = lowered[at - 1 : at], lowered[at + size : at + size + 1]
            if (before.isascii() and before.isalnum()) or (after.isascii() and after.isalnum()):
                break
            text, lowered = text[:at] + text[at + size :], lowered[:at] + lowered[at + size :]
            at = lowered.find(word)
    return text


def strip_keywords(text: Column, keywords: Sequence[str], mode: str = "first_occurrence") -> Column:
    """Remove keywords in list order.

    ``first_occurrence``: a keyword is removed while its first occurrence stands free, and given
    up as soon as that first occurrence touches a letter or digit (Arrow batches).
    ``whole_word``: every free-standing occurrence is removed (native expression).
    """
    words = [w for w in keywords if w]
    if mode == "whole_word":
        for word in words:
            quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])", "")
        return text
    if mode != "first_occurrence":
        raise ValueError(f"unknown mode {mode!r}")
    fold = str.maketrans(UPPER, LOWER)

    @F.pandas_udf(StringType())
    def strip(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else _strip_one(s, words, fold))

    return strip(text)


def tidy(text: Column) -> Column:
    """Collapse whitespace, drop trailing ``- ( [`` and trim."""
    collapsed = F.regexp_replace(text, r"\s+", " ")
    return F.trim(F.regexp_replace(collapsed, r"[-(\[ ]+\z", ""))


def extract_title(text: Column, keywords: Sequence[str] = (), mode: str = "first_occurrence") -> Column:
    name = cut_at_season(keep_year_parens(drop_brackets(norm_separators(text))))
    return tidy(strip_keywords(name, keywords, mode) if keywords else name)


def special_count(text: Column) -> Column:
    """Bytes that are neither ASCII letters or digits nor white space."""
    return F.octet_length(F.regexp_replace(text, r"[A-Za-z0-9\s]+", "")).cast("bigint")


def special_ratio(text: Column) -> Column:
    size = F.octet_length(text)
    return F.when(size > 0, special_count(text) / size).otherwise(F.lit(0.0))


def is_special_dense(text: Column) -> Column:
    """More than 20 % special bytes, in whole numbers."""
    return special_count(text) * 5 > F.octet_length(text)


def format_size(size: Column) -> Column:
    """Two decimals, ties to even as C's printf rounds them, in whole-number arithmetic."""
    size = size.cast("bigint")
    out = F.concat(size.cast("string"), F.lit(".00 B"))
    # Unit names.
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        base = 1 << (10 * power)
        whole = F.shiftright(size, 10 * power)
        scaled = size.bitwiseAND(F.lit(base - 1)) * 100
        cents = F.shiftright(scaled, 10 * power)
        rest = scaled.bitwiseAND(F.lit(base - 1)) * 2
        up = (rest > base) | ((rest == base) & (cents % 2 == 1))
        cents = cents + F.when(up, 1).otherwise(0)
        whole_part = whole + F.when(cents == 100, 1).otherwise(0)
        shown = F.concat(
            whole_part.cast("string"),
            F.lit("."),
            F.lpad((cents % 100).cast("string"), 2, "0"),
            F.lit(" " + unit),
        )
        out = F.when(size >= base, shown).otherwise(out)
    return out


def format_count(n: Column) -> Column:
    """Digit groups of three up to the millions group, which stays whole."""
    n = n.cast("bigint")
    below = F.lpad((n % 1000).cast("string"), 3, "0")
    thousands = F.floor(n / 1000)
    middle = F.lpad((thousands % 1000).cast("string"), 3, "0")
    return (
        F.when(n >= 1_000_000, F.concat_ws(",", F.floor(n / 1_000_000).cast("string"), middle, below))
        .when(n >= 1000, F.concat_ws(",", thousands.cast("string"), below))
        .otherwise(n.cast("string"))
    )


def format_uptime(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor(seconds % 3600 / 60).cast("bigint")
    return F.concat(hours.cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))


def percent_encode(text: Column) -> Column:
    """RFC 3986: letters, digits and ``-_.~`` stay, every other byte becomes ``%XX``."""
    form = F.url_encode(text)
    return F.replace(
        F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"),
        F.lit("~"),
    )


def percent_decode(text: Column) -> Column:
    """``%XX`` to bytes and ``+`` to a space; a malformed escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def magnet_link(info_hash: Column, name: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash, F.lit("&dn="), percent_encode(name))
