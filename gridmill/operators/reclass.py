"""Values replaced by rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this number become one expression; more are a joined table.
INLINE = 500


def reclassify(cells: DataFrame, rules: Mapping | DataFrame, unlisted: str = "keep", value: str = "value", out: str | None = None) -> DataFrame:
    """``value`` by the rules (a dictionary, or rows src, dst; two targets for one source are an error).  Unlisted values: keep, zero, nodata, or raise."""
    if unlisted not in ("keep", "zero", "nodata", "raise"):
        raise ValueError(f"unlisted is {unlisted!r}")
    out = out or value
    if isinstance(rules, Mapping) and len(rules) > INLINE:
        rules = cells.sparkSession.createDataFrame([(float(k), float(v)) for k, v in rules.items()], "src double, dst double")
    v = F.col(value)
    if isinstance(rules, Mapping):
        new = hit = None
        for k, d in rules.items():
            new = F.when(v == k, F.lit(d)) if new is None else new.when(v == k, F.lit(d))
        hit = v.isin(list(rules)) if rules else F.lit(False)
        table = cells.withColumn("_new", new if new is not None else F.lit(None)).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    else:
        # A source with two different targets would multiply cells.
        once = rules.groupBy(F.col("src").alias("_src")).agg(F.min("dst").alias("_new"), F.max("dst").alias("_other"))
        clash = F.raise_error(F.concat(F.lit("two targets for "), F.col("_src").cast("string"))).cast(dict(rules.dtypes)["dst"])
        pairs = once.select("_src", F.when(F.col("_new").eqNullSafe(F.col("_other")), F.col("_new")).otherwise(clash).alias("_new"), F.lit(True).alias("_is"))
        table = cells.join(pairs, v == F.col("_src"), "left").withColumn("_hit", F.coalesce("_is", F.lit(False))).drop("_src", "_is")
    if unlisted == "raise":
        missing = table.filter(~F.col("_hit") & v.isNotNull()).select(value).distinct().take(5)
        if missing:
            raise ValueError(f"values without a rule: {[r[0] for r in missing]}")
    rest = {"keep": v, "zero": F.when(v.isNotNull(), F.lit(0)), "nodata": F.lit(None), "raise": v}[unlisted]
    return table.withColumn(out, F.when(F.col("_hit"), F.col("_new")).otherwise(rest)).drop("_new", "_hit")


def relabel(df: DataFrame, correspondence: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """A label column looked up as another one, kept where the correspondence does not list it."""
    table = correspondence.select(F.col(key).alias("_k"), F.col(name).alias("_n")).dropDuplicates(["_k"])
    return df.join(table, F.col(label) == F.col("_k"), "left").withColumn(label, F.coalesce("_n", label)).drop("_k", "_n")


def correspondence(df: DataFrame, src: str, dst: str) -> DataFrame:
    """One row a target: its least source, and all sources in order."""
    return df.groupBy(dst).agg(F.min(src).alias("first_src"), F.sort_array(F.collect_set(src)).alias("all_src"))
