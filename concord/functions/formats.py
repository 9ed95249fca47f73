"""Translation of strftime and TO_CHAR formats to Spark's."""

from __future__ import annotations

import re

# Strftime directives and the letters of Spark's datetime patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "R": "HH:mm", "D": "MM/dd/yy", "z": "xx", "Z": "zzz", "%": "'%'",
}
DATE_FORMAT, TIMESTAMP_FORMAT = "%Y-%m-%d", "%Y-%m-%d %H:%M:%S"


def datetime_pattern(strftime: str) -> str:
    """Spark pattern of a strftime format; letters outside directives are quoted."""
    out = []
    for directive, text in re.findall(r"%-?(.)|([^%]+)", strftime):
        if text:
            out.append(re.sub(r"[A-Za-z]+|'", lambda m: "''" if m[0] == "'" else f"'{m[0]}'", text))
        elif directive in STRFTIME:
            out.append(STRFTIME[directive])
        else:
            raise ValueError(f"no Spark pattern for %{directive}")
    return "".join(out)


def number_pattern(to_char: str) -> tuple[str, bool]:
    """(Spark number format, whether fill is suppressed) of a TO_CHAR format: the prefix FM isn't known to Spark."""
    bare = to_char[2:] if to_char[:2].upper() == "FM" else to_char
    return bare, bare != to_char
