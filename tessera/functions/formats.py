"""MySQL, Joda and Teradata format strings as Spark datetime patterns."""

from __future__ import annotations

import re

#: MySQL tokens that parsing knows.
MYSQL_FORMAT = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h",
    "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD",
    "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%",
}
#: The MySQL tokens that formatting knows; other tokens stay as they are written.
MYSQL_PUT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "MM", "%d": "dd", "%e": "dd", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%T": "HH:mm:ss"}
#: Joda tokens, which Spark mostly shares.
JODA_FORMAT = {"yyyy": "yyyy", "YYYY": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "a": "a", "EEEE": "EEEE", "EEE": "EEE", "E": "EEE", "D": "D"}
#: Teradata tokens.
TERADATA_FORMAT = {"yyyy": "yyyy", "yy": "yy", "mm": "MM", "dd": "dd", "hh24": "HH", "hh": "hh", "mi": "mm", "ss": "ss", "am": "a", "pm": "a"}


def spark_pattern(fmt: str, tokens: dict[str, str]) -> str:
    """The format with its tokens put in Spark's; other letters are quoted."""
    parts = "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))
    out, at = "", 0
    fold = tokens is TERADATA_FORMAT
    if tokens is MYSQL_PUT:
        parts += "|%."  # a percent sign takes the next character with it
    for m in re.finditer(parts, fmt, re.IGNORECASE if fold else 0):
        out += _plain(fmt[at : m.start()]) + tokens.get(m[0].lower() if fold else m[0], _plain(m[0]))
        at = m.end()
    return out + _plain(fmt[at:])


def _plain(s: str) -> str:
    return re.sub(r"[A-Za-z%#\[\]{}]+", lambda m: f"''{m[0]}''", s)
