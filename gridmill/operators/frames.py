"""Guarded joins, group-by, pivots and column tools for tables."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "^"


def infer_key(left: DataFrame, right: DataFrame) -> str:
    """The first shared whole-number column, else the first shared one."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    kinds = dict(left.dtypes)
    return next((c for c in shared if kinds[c] in ("int", "bigint", "smallint", "tinyint")), shared[0])


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, how: str = "full", left_on: str | None = None, right_on: str | None = None, clash: str = "keep_both", drop_identical: bool = False) -> DataFrame:
    """Join with a rule for clashing columns: keep_both (the right one gets ``_right``), keep_left, keep_right, or raise.

    With ``drop_identical`` right columns that equal the left ones in every joined row are dropped (one more pass).
    """
    if left_on and right_on:
        right, on = right.withColumnRenamed(right_on, left_on), left_on
    keys = [on] if isinstance(on, str) else list(on) if on else [infer_key(left, right)]
    both = [c for c in right.columns if c in left.columns and c not in keys]
    if both and clash == "raise":
        raise ValueError(f"columns on both sides: {both}")
    if clash == "keep_left":
        right = right.drop(*both)
    elif clash == "keep_right":
        left = left.drop(*both)
    else:
        right = right.withColumnsRenamed({c: f"{c}_right" for c in both})
    out = left.join(right, keys, how)
    pairs = [c for c in both if f"{c}_right" in out.columns] if drop_identical and clash == "keep_both" else []
    if pairs:
        same = out.agg(*[F.bool_and(F.col(c).eqNullSafe(F.col(f"{c}_right"))).alias(c) for c in pairs]).first()
        out = out.drop(*[f"{c}_right" for c in pairs if same[c]])
    return out


def merge_all(frames: Sequence[DataFrame], on: str, suffixes: Sequence[str], how: str = "full") -> DataFrame:
    """N-way join; every column but the key gets its table's suffix."""
    named = [f.withColumnsRenamed({c: f"{c}_{s}" for c in f.columns if c != on}) for f, s in zip(frames, suffixes, strict=True)]
    return reduce(lambda a, b: a.join(b, on, how), named)


def merge_remapped(left: DataFrame, right: DataFrame, remap: DataFrame, on: str, old: str, new: str, how: str = "left") -> DataFrame:
    """The right table's key translated by a two-column table (untranslated keys stay), then joined."""
    table = remap.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"])
    moved = right.join(table, F.col(on) == F.col("_old"), "left").withColumn(on, F.coalesce("_new", on)).drop("_old", "_new")
    return merge(left, moved, on, how)


def match_candidates(left: DataFrame, right: DataFrame, key: str, k: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(key, match, score, rank): the ``k`` most similar left keys of each distinct right key, for a look before merging."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "match")
    return _similar(left, right, key, cutoff).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_matches(left: DataFrame, right: DataFrame, key: str, cutoff: float = 0.6) -> DataFrame:
    """(key, match, score): each distinct right key with the most similar left key, at least ``cutoff``."""
    scored = _similar(left, right, key, cutoff)
    return scored.groupBy(key).agg(F.max_by(F.struct("match", "score"), F.struct("score", F.col("match"))).alias("b")).select(key, F.col("b.match").alias("match"), F.col("b.score").alias("score"))


def _similar(left: DataFrame, right: DataFrame, key: str, cutoff: float, gram: int = 2) -> DataFrame:
    """(key, match, score) of all pairs of distinct keys that reach ``cutoff``.

    Only pairs that share a run of ``gram`` letters (or are equal) are compared, so no cross join is made.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - gram + 1, F.lit(1))), lambda i: F.lower(F.substring(c, i, gram))))
    a = left.select(F.col(key).alias("match")).filter("match is not null").distinct().withColumn("g", F.explode(grams(F.col("match"))))
    b = right.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("g", F.explode(grams(F.col(key))))
    pairs = b.join(a, "g").select(key, "match").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn("score", ratio(F.col(key), F.col("match"))).filter(F.col("score") >= cutoff)


def fuzzy_merge(left: DataFrame, right: DataFrame, key: str, how: str = "full", cutoff: float = 0.6) -> DataFrame:
    """Right keys replaced by their best left match, then joined."""
    found = best_matches(left, right, key, cutoff).select(F.col(key).alias("_k"), "match")
    moved = right.join(found, F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("match", key)).drop("_k", "match")
    return merge(left, moved, key, how)


def group(df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), aggs: Mapping[str, str] | None = None, preserve: str | None = None, conflict: str = "concat_unique") -> DataFrame:
    """Group with sums and named aggregates (any SQL aggregate, ``concat`` or ``concat_unique``).

    ``preserve``: "all" keeps the other columns, joining different values in order with
    ``^``; "valid" keeps only those that have one value in every group.  NULLs are skipped.
    """
    joined = lambda c, unique: F.array_join(F.sort_array((F.collect_set if unique else F.collect_list)(F.col(c).cast("string"))), SEPARATOR)
    out: dict[str, Column] = {c: F.sum(c) for c in sums}
    for c, name in (aggs or {}).items():
        out[c] = joined(c, name == "concat_unique") if name.startswith("concat") else F.expr(f"{name}(`{c}`)")
    rest = [c for c in df.columns if c not in by and c not in out] if preserve else []
    if preserve == "valid" and rest:
        most = df.groupBy(*by).agg(*[F.count_distinct(c).alias(c) for c in rest]).agg(*[F.max(c).alias(c) for c in rest]).first()
        rest = [c for c in rest if most[c] <= 1]
    kinds = dict(df.dtypes)
    for c in rest:
        if preserve == "valid":
            out[c] = F.max(c)
        elif conflict == "raise":
            out[c] = F.when(F.count_distinct(c) <= 1, F.max(c)).otherwise(F.raise_error(F.lit(f"different values of {c} in a group")).cast(kinds[c]))
        else:
            out[c] = joined(c, conflict == "concat_unique")
    order = [c for c in df.columns if c in out]
    return df.groupBy(*by).agg(*[out[c].alias(c) for c in order])


def pivot_up(df: DataFrame, rows: Sequence[str], columns: str, values: Sequence[str], levels: Sequence, aggs: Sequence[str] = ("sum",), filters: Mapping[str, Sequence] | None = None, strict: bool = True) -> DataFrame:
    """Filter, then one row a row key and one column a level, value and aggregate; with ``strict`` duplicates and gaps raise."""
    for c, allowed in (filters or {}).items():
        df = df.filter(F.col(c).isin(list(allowed)))
    out = []
    for level in levels:
        here = F.col(columns) == level
        for v in values:
            for a in aggs:
                cell = getattr(F, a)(F.when(here, F.col(v)))
                if strict:
                    n = F.count_if(here & F.col(v).isNotNull())
                    cell = F.when(n == 1, cell).otherwise(F.raise_error(F.concat(F.lit(f"{v} of {level}: values "), n.cast("string"))).cast("double"))
                out.append(cell.alias(f"{v}-{level}" + (f"-{a}" if len(aggs) > 1 else "")))
    return df.groupBy(*rows).agg(*out)


def change_from_focal(df: DataFrame, by: Sequence[str], level: str, focal: object, value: str, base: str = "own") -> DataFrame:
    """Difference and percent change of each level against the focal one; the base is the cell's own value or the focal one."""
    at = F.max(F.when(F.col(level) == focal, F.col(value))).over(Window.partitionBy(*by))
    out = df.withColumn("_focal", at).withColumn("difference", F.col(value) - F.col("_focal"))
    return out.withColumn("percent_change", F.try_divide(F.col("difference"), F.col(value if base == "own" else "_focal")) * 100).drop("_focal")


def fill_from(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """The left column, or the right one where it is missing; both are dropped."""
    return df.withColumn("_filled", F.coalesce(left, right)).drop(left, right).withColumnRenamed("_filled", out)


def cast_type(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.select(*[F.col(c).cast(new).alias(c) if t == old else F.col(c) for c, t in df.dtypes])


def smart_cast(df: DataFrame) -> DataFrame:
    """String columns whose values are all whole numbers, or all numbers, are cast; one pass decides for all."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    tests = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(f"{kind}:{c}") for c in text for kind in ("long", "double")]
    row = df.agg(*tests, *[F.count(c).alias(f"n:{c}") for c in text]).first()
    kind = {c: next((k for k in ("long", "double") if row[f"n:{c}"] and not row[f"{k}:{c}"]), "string") for c in text}
    return df.select(*[F.col(c).cast(kind[c]).alias(c) if c in kind else F.col(c) for c in df.columns])


def reorder(df: DataFrame, first: Sequence[str] = (), rest: str = "alphabetic", drop: Sequence[str] = ()) -> DataFrame:
    others = [c for c in df.columns if c not in first and c not in drop]
    others = sorted(others, reverse=rest == "reverse") if rest in ("alphabetic", "reverse") else others
    return df.select(*[c for c in first if c not in drop], *others)


def move_column(df: DataFrame, name: str, anchor: str, after: bool = False) -> DataFrame:
    order = [c for c in df.columns if c != name]
    order.insert(order.index(anchor) + after, name)
    return df.select(*order)


def compare_sets(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(value, side): in both, left_only or right_only; NULLs are left out."""
    sides = left.select(F.col(column).alias("value"), F.lit(1).alias("s")).union(right.select(F.col(column).alias("value"), F.lit(2).alias("s")))
    where = sides.filter("value is not null").groupBy("value").agg(F.bit_or("s").alias("s"))
    return where.select("value", F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left_only").otherwise("right_only").alias("side"))


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    """Equal values with equal counts, in any order."""
    return not left.exceptAll(right).take(1) and not right.exceptAll(left).take(1)


def distinct_in_order(df: DataFrame, value: str, pos: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def column_profile(df: DataFrame) -> DataFrame:
    """(column, n_distinct, n_null) of every column in one pass."""
    row = df.agg(*[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)], *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(df.columns)])).alias("s")).select("s.*")


def parse_flex_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """A configuration column as JSON text of its parsed values (batched; SQL cannot count brackets)."""
    import json

    from gridmill.functions.text import parse_flex

    @F.pandas_udf("string")
    def parsed(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in cells:
            yield s.map(lambda x: json.dumps(parse_flex(x)))

    return df.withColumn(out, parsed(F.col(column)))
