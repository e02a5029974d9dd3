"""Configuration tables as parameters: the value grammar, row- and column-oriented definitions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from gridmill.functions.text import CLOSE, OPEN, split_outside_brackets

MOST_ROWS = 10_000
_LITERAL = re.compile(r"(int|float)\(\s*([-+0-9.eE]+)\s*\)\Z")


def token(text: str) -> object:
    """``int(3)`` and ``float(2.5)`` as numbers, other text stripped."""
    text = text.strip()
    m = _LITERAL.match(text)
    return (int if m[1] == "int" else float)(m[2]) if m else text


def parse_value(name: str, text: str | None) -> object:
    """A cell by the first rule that fits: template, list, dictionary, path, years, dimensions, nan, plain text."""
    if text is None:
        return None
    s = str(text).strip()
    if OPEN in s or CLOSE in s:
        return s
    if s.startswith("[") and s.endswith("]"):
        return [token(p) for p in split_outside_brackets(s[1:-1])] if s[1:-1].strip() else []
    if s.startswith("{") and s.endswith("}"):
        return {k.strip(): token(v) for k, colon, v in (p.partition(":") for p in split_outside_brackets(s[1:-1])) if colon}
    if name.endswith("_path"):
        return None if s.lower() in ("", "nan") else s
    if "year" in name:
        parts = s.split()
        values = [int(float(p)) if re.fullmatch(r"-?\d+(\.0*)?", p) else p for p in parts if p.lower() != "nan"]
        return values[0] if name == "key_base_year" and values else values
    if "dimensions" in name:
        return [None if p.lower() == "nan" else p for p in s.split()]
    return None if s.lower() in ("nan", "") else token(s)


def orientation(df: DataFrame) -> str:
    """"vertical" for a table of names and values, else "row"."""
    return "vertical" if len(df.columns) == 2 and {c.lower() for c in df.columns} & {"key", "name", "attribute"} else "row"


def parameters(df: DataFrame, defaults: Mapping[str, object] | None = None) -> dict[str, object]:
    """The first row, or all name-value pairs, of a small configuration table, on top of the defaults; more than ``MOST_ROWS`` rows are an error."""
    rows = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a configuration table has at most {MOST_ROWS} rows")
    if orientation(df) == "vertical":
        key = next(c for c in df.columns if c.lower() in ("key", "name", "attribute"))
        value = next(c for c in df.columns if c != key)
        cells = {r[key]: r[value] for r in rows}
    else:
        cells = rows[0] if rows else {}
    return dict(defaults or {}) | {k: parse_value(k, v) for k, v in cells.items()}


def fill(text: str, values: Mapping[str, object]) -> str:
    """Each ``<^name^>`` of a text replaced; names without a value stay."""
    return re.sub(re.escape(OPEN) + r"([^\^]*)" + re.escape(CLOSE), lambda m: str(values[m[1]]) if m[1] in values else m[0], text)


def runs(tokens: list[object]) -> list[object]:
    """Neighbouring dictionaries merged into one, neighbouring others gathered in lists."""
    out: list[object] = []
    for t in tokens:
        if isinstance(t, Mapping):
            if out and isinstance(out[-1], dict):
                out[-1].update(t)
            else:
                out.append(dict(t))
        elif out and isinstance(out[-1], list):
            out[-1].append(t)
        else:
            out.append([t])
    return out
