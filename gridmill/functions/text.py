"""Column functions on strings: templates, paths, literals, nested values."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the template marks.
OPEN, CLOSE = "<^", "^>"


def has_template(s: Column) -> Column:
    return F.contains(s, F.lit(OPEN)) | F.contains(s, F.lit(CLOSE))


def fill_template(s: Column, values: Mapping[str, Column]) -> Column:
    """Each ``<^name^>`` replaced by its value; names without one stay."""
    for name, value in values.items():
        s = F.replace(s, F.lit(f"{OPEN}{name}{CLOSE}"), value.cast("string"))
    return s


def template_names(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"<\^([^\^]*)\^>"), 1)


def template_parts(s: Column) -> Column:
    """Plain pieces and marked names in order, as structs (key, text): text before a mark has a null key."""
    found = F.regexp_extract_all(s, F.lit(r"(<\^[^\^]*\^>|(?:(?!<\^).)+)"), 1)
    return F.transform(found, lambda p: F.struct(F.when(F.startswith(p, F.lit(OPEN)), F.regexp_extract(p, r"<\^([^\^]*)\^>", 1)).alias("key"), F.when(~F.startswith(p, F.lit(OPEN)), p).alias("text")))


def path_parts(p: Column) -> Column:
    """Struct: folder before the parent, parent folder, root of the file name, extension."""
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.struct(
        F.regexp_extract(folder, r"^(.*)/[^/]*$", 1).alias("prior"),
        F.regexp_extract(folder, r"([^/]*)$", 1).alias("parent"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("root"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"),
    )


def replace_ext(p: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit(ext))


def insert_before_ext(p: Column, text: str) -> Column:
    return F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit(text), F.regexp_extract(p, r"(\.[^./]*)$", 1))


def looks_like_path(s: Column) -> Column:
    return F.rlike(s, F.lit(r"[/\\]|\.[A-Za-z0-9]{1,8}$"))


def timestamp_in(p: Column) -> Column:
    """The time that a file name ends in (``_YYYYMMDD_HHMMSS``, perhaps with microseconds), else NULL."""
    return F.try_to_timestamp(F.concat(*[F.regexp_extract(p, r"_(\d{8})_(\d{6})(?:_\d+)?(?:\.[^./]*)?$", k) for k in (1, 2)]), F.lit("yyyyMMddHHmmss"))


def strings_between(s: Column, left: str, right: str) -> Column:
    """All shortest stretches between two marks."""
    return F.regexp_extract_all(s, F.lit(re.escape(left) + r"(.*?)" + re.escape(right)), 1)


def replace_many(s: Column, changes: Mapping[str, str]) -> Column:
    for old, new in changes.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def replace_between(s: Column, left: str, right: str, new: str) -> Column:
    """The shortest stretches between two marks replaced; the marks stay."""
    return F.regexp_replace(s, F.lit(f"(?s)({re.escape(left)}).*?({re.escape(right)})"), F.lit("$1" + new.replace("\\", "\\\\").replace("$", "\\$") + "$2"))


def safe_string(s: Column) -> Column:
    """Letters, digits and single underscores, in lower case: fit for file and column names."""
    return F.trim(F.regexp_replace(F.lower(s), F.lit(r"[^a-z0-9]+"), F.lit("_")), F.lit("_"))


def path_to_url(p: Column) -> Column:
    """A file path as a file URL: backslashes turned, special characters escaped."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(F.translate(p, "\\", "/")), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def url_to_path(u: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(u, r"^file://", ""), F.lit("+"), F.lit("%2B")))


def pretty_seconds(x: Column) -> Column:
    """Hours, minutes and seconds as ``1h 02m 03s``."""
    whole = F.floor(x).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), two(F.floor(whole / 60) % 60), F.lit("m "), two(whole % 60), F.lit("s"))


def split_two(s: Column, delimiter: str) -> Column:
    """Both sides of the delimiter; without one the string twice."""
    parts = F.split(s, re.escape(delimiter))
    return F.when(F.size(parts) == 1, F.array(s, s)).otherwise(parts)


def list_literal(s: Column) -> Column:
    """``[a, b]`` as an array of trimmed strings."""
    return F.transform(F.split(F.regexp_replace(s, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.trim(x))


def dict_literal(s: Column) -> Column:
    """``{k: v, ...}`` as a map of trimmed strings."""
    pairs = F.transform(F.split(F.regexp_replace(s, r"^\s*\{|\}\s*$", ""), ","), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.map_from_entries(pairs)


def cast_token(s: Column) -> Column:
    """``int(3)`` and ``float(2.5)`` as numbers (double), other text as NULL."""
    return F.regexp_extract(s, r"^\s*(?:int|float)\(\s*([-+0-9.eE]+)\s*\)\s*$", 1).try_cast("double")


def attribute_kind(name: Column, value: Column) -> Column:
    """Which rule of the value grammar a configuration cell falls under, first match first."""
    v = F.trim(value)
    return (
        F.when(has_template(v), "template").when(F.rlike(v, F.lit(r"^\[.*\]$")), "list").when(F.rlike(v, F.lit(r"^\{.*\}$")), "dict")
        .when(F.endswith(name, F.lit("_path")), "path").when(F.contains(name, F.lit("year")), "years").when(F.contains(name, F.lit("dimensions")), "dimensions")
        .when(F.lower(v) == "nan", "none").otherwise("text")
    )


def years(v: Column) -> Column:
    return F.transform(F.split(F.trim(v), r"\s+"), lambda x: x.try_cast("int"))


def split_outside_brackets(text: str, delimiter: str = ",") -> list[str]:
    """Cut at delimiters that stand outside [] and {} (a regular expression cannot count nesting)."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[{") - (c in "]}")
        if c == delimiter and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]]


def parse_flex(text: str | None) -> object:
    """A configuration cell as None, number, list, dictionary or text."""
    if text is None or (s := text.strip()) in ("", "None", "nan", "NaN"):
        return None
    try:
        return json.loads(s)
    except ValueError:
        pass
    if s.startswith("{") or (":" in s and not s.startswith("[")):
        pairs = [p.partition(":") for p in split_outside_brackets(s.strip("{}"))]
        return {k.strip().strip("'\""): parse_flex(v) for k, colon, v in pairs if colon}
    if s.startswith("[") or "," in s:
        inner = s[1:-1] if s.startswith("[") and s.endswith("]") else s
        return [parse_flex(p) for p in split_outside_brackets(inner)]
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            continue
    return s.strip("'\"")
