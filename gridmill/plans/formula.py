"""Formulas ``y ~ a + b*c + a^2 + log(b) + dummy(k)[1,2] + intercept`` as columns.

Terms are joined by ``+``.  A term is a product, quotient or power of names, ``log``,
``log10``, ``dummy(name)[values]`` (one 0/1 column a value), ``valuemask(name)[values]``
(keeps rows whose value is listed) or ``conditionalmask(name, value, op)`` (keeps rows that compare so).
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


@dataclass
class Formula:
    dependent: str
    terms: dict[str, Column] = field(default_factory=dict)
    masks: list[Column] = field(default_factory=list)
    intercept: bool = False


def _values(text: str) -> list[float]:
    return [float(v) for v in text.split(",") if v.strip()]


def _factor(text: str) -> Column:
    text = text.strip()
    if m := re.fullmatch(r"(log10|log)\((\w+)\)", text):
        return (F.log10 if m[1] == "log10" else F.ln)(F.col(m[2]))
    if m := re.fullmatch(r"(\w+)\s*\^\s*(\d+)", text):
        return F.pow(F.col(m[1]), F.lit(int(m[2])))
    if re.fullmatch(r"[-\d.]+", text):
        return F.lit(float(text))
    if re.fullmatch(r"\w+", text):
        return F.col(text)
    raise ValueError(f"not a factor: {text!r}")


def _term(text: str) -> Column:
    parts = re.split(r"([*/-])", text)
    out = _factor(parts[0])
    for op, part in zip(parts[1::2], parts[2::2], strict=True):
        f = _factor(part)
        out = out * f if op == "*" else F.try_divide(out, f) if op == "/" else out - f
    return out


def parse(text: str) -> Formula:
    left, tilde, right = text.partition("~")
    if not tilde:
        raise ValueError("a formula has the form y ~ terms")
    out = Formula(left.strip())
    for raw in re.split(r"\+(?![^\[\]()]*[\])])", right):
        term = raw.strip()
        if term in ("intercept", "1"):
            out.intercept = True
        elif m := re.fullmatch(r"dummy\((\w+)\)\[([^\]]*)\]", term):
            for v in _values(m[2]):
                out.terms[f"{m[1]}_{v:g}"] = (F.col(m[1]) == v).cast("double")
        elif m := re.fullmatch(r"valuemask\((\w+)\)\[([^\]]*)\]", term):
            out.masks.append(F.col(m[1]).isin(_values(m[2])))
        elif m := re.fullmatch(r"conditionalmask\((\w+)\s*,\s*([-\d.]+)\s*,\s*([<>=!]+)\)", term):
            out.masks.append(_COMPARE[m[3]](F.col(m[1]), F.lit(float(m[2]))))
        elif term:
            out.terms[re.sub(r"\W+", "_", term).strip("_")] = _term(term)
    return out


def design(df: DataFrame, formula: Formula | str, ndv: float | None = None, stride: int = 1) -> DataFrame:
    """The dependent column and one column a term; rows with a gap, the dependent's no-data value or a failed mask go."""
    f = parse(formula) if isinstance(formula, str) else formula
    for mask in f.masks:
        df = df.filter(mask)
    if ndv is not None:
        df = df.filter(F.col(f.dependent) != ndv)
    if stride > 1 and "row" in df.columns:
        df = df.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    out = df.select(F.col(f.dependent).cast("double").alias("y"), *[t.cast("double").alias(n) for n, t in f.terms.items()])
    return out.dropna()


def dummies(df: DataFrame, column: str, most: int = 200) -> tuple[DataFrame, list[str]]:
    """``df`` with a 0/1 column for each distinct value, of which there may be at most ``most``."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    made = {f"{column}_{v}": (F.col(column) == v).cast("int") for v in values}
    return df.withColumns(made), list(made)


def transforms(df: DataFrame, column: str, kinds: tuple[str, ...] = ("square", "cube", "log")) -> DataFrame:
    """Powers 2 to 5 (square, cube, quad, quint), log and log10 of a column; logarithms of what is not positive are NULL."""
    powers = {"square": 2, "cube": 3, "quad": 4, "quint": 5}
    x = F.col(column).cast("double")
    logs = {"log": F.when(x > 0, F.ln(x)), "log10": F.when(x > 0, F.log10(x))}
    return df.withColumns({f"{column}_{k}": F.pow(x, F.lit(powers[k])) if k in powers else logs[k] for k in kinds})


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))
