"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from setwise.functions.times import col, int_div


def length_trimmed(x: Column | str) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(col(x)))


def zero_pad(n: Column | str, width: int) -> Column:
    """Fixed-width digits; NULL when the number does not fit."""
    text = col(n).cast("string")
    return F.when(F.length(text) <= width, F.lpad(text, width, "0"))


def quote_name(x: Column | str) -> Column:
    """Wrap in brackets, doubling any closing bracket."""
    return F.concat(F.lit("["), F.replace(col(x), F.lit("]"), F.lit("]]")), F.lit("]"))


def name_part(x: Column | str, part: int, separator: str = ".") -> Column:
    """``part`` 1 is the last piece of a dotted name, 2 the one before; NULL if absent."""
    return F.try_element_at(F.split(col(x), re.escape(separator)), F.lit(-part))


def path_directory(path: Column | str, separator: str = "/") -> Column:
    """Everything before the last separator; empty if there is none."""
    p = col(path)
    at = F.instr(F.reverse(p), separator)
    return F.when(at > 0, F.substring(p, F.lit(1), F.length(p) - at)).otherwise(F.lit(""))


def path_file(path: Column | str, separator: str = "/") -> Column:
    """Everything after the last separator."""
    return F.substring_index(col(path), separator, -1)


def url_host(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def swap_bytes(hex_text: Column | str, digits: int = 16) -> Column:
    """``digits`` hex digits with all their bytes in reverse order; NULL for a text of another length."""
    x = col(hex_text)
    return F.when(F.length(x) == digits, F.concat(*[F.substring(x, i, 2) for i in range(digits - 1, 0, -2)]))


def swap_first_bytes(hex_text: Column | str) -> Column:
    """The first eight hex digits with their four bytes in reverse order."""
    x = col(hex_text)
    return F.concat(*[F.substring(x, i, 2) for i in (7, 5, 3, 1)])


def scrub_control(x: Column | str) -> Column:
    """Unprintable characters become ``?``, NUL disappears; tab, LF and CR stay."""
    no_nul = F.regexp_replace(col(x), r"\x00", "")
    return F.regexp_replace(no_nul, r"[\x01-\x08\x0B\x0C\x0E-\x1F]", "?")


def text_slice(text: Column | str, start_offset: Column | str, end_offset: Column | str) -> Column:
    """Cut by byte offsets of two-byte characters, both ends included.

    An end of -1 means to the end of the text. Offsets that cannot belong to
    this text (negative or past its end, or crossed) give the whole text.
    """
    t, a, b = col(text), col(start_offset), col(end_offset)
    first = int_div(a, 2)
    last = F.when(b == -1, F.length(t) - 1).otherwise(int_div(b, 2))
    sane = (a >= 0) & (first < F.length(t)) & (last >= first) & (last < F.length(t))
    return F.when(sane, F.substring(t, first.cast("int") + 1, (last - first).cast("int") + 1)).otherwise(t)


def kv_value(x: Column | str, name: str, type_: str = "bigint", assign: str = r"\s*=\s*", stop: str = ",&;} ") -> Column:
    """The value after ``name =`` in a description string, typed; NULL if absent or ill-formed."""
    pattern = rf"(?:^|[^A-Za-z0-9_]){re.escape(name)}{assign}([^{re.escape(stop)}]*)"
    found = F.regexp_extract(col(x), pattern, 1)
    return F.when(found != "", found.try_cast(type_))


def size_kb(x: Column | str) -> Column:
    """``'123 KB'`` to 123."""
    return F.rtrim(F.replace(col(x), F.lit("KB"), F.lit(""))).cast("bigint")


def thousands(x: Column | str, places: int = 0) -> Column:
    return F.format_number(col(x), places)


def pad_left(x: Column, width: Column) -> Column:
    """Right-align: blanks in front up to ``width``, never cutting."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.length(x), F.lit(0)).cast("int")), x)


def wildcard_regex(pattern: str) -> str:
    """A ``%``/``_``/``[class]`` wildcard pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{body}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def contains_text(x: Column | str, snippet: str) -> Column:
    """Case-insensitive containment; binary input is read as UTF-8."""
    return F.contains(F.lower(col(x)), F.lit(snippet.lower()))


def decode_utf8(x: Column | str) -> Column:
    return F.decode(col(x), "UTF-8")
