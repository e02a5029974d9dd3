"""Quality rules with thresholds that adapt to each language and source.

Everything here is DataFrame expressions.  Per document a few counts are taken
over the whole text; four rates of the documents that pass the base rules go
into quantile sketches: histograms with 32 linear steps in each power of two
(relative error 1/32), counted per language and source.  Such sketches merge by
adding counts, so partial aggregation does all the work before the shuffle and a
hot source costs no more than any other.  A rate may lie above the third
quartile by a multiple of the quartile range plus a floor, and never above a
ceiling; groups with few documents use the merged sketch of their language.

Null text has no words and fails the base rules.  Null languages and sources are
groups of their own.  Repeated rows count as often as they occur.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.shared import saved

#: White space, symbols and the base rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: rate -> (multiple of the quartile range, floor, ceiling); a rate above the lesser of q75 + multiple * (q75 - q25) + floor and ceiling
#: is rejected.  The ceilings lie below what a rate can reach, so that no rule is ever off, however noisy its group.
RATES = {"symbol_rate": (4, 60, 800), "dup_line_rate": (4, 400, 800), "repeat_rate": (4, 350, 450), "length_rate": (4, 150, 2000)}
MIN_GROUP = 50
#: Threshold tables of at most this many rows are broadcast.
BROADCAST_ROWS = 50_000
SALTS = 32
#: Up to so many repeated windows are looked up one by one, more by sorting.
FEW_REPEATS = 24


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``quality`` in place of the text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Each step carries on only what the next ones need: arrays as large as the text are not copied from step to step.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    symbols = F.length(text) - F.length(_without(text, SYMBOLS))
    out = docs.select(*rest, F.length(_without(text, SPACES)).cast("long").alias("_chars"), symbols.cast("long").alias("_symbols"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    # 64-bit hashes stand for the windows of three words; two different windows of one text share one with a chance below n**2 / 2**65.
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>"))
    n_lines = F.size("_lines").cast("long")
    n_dup = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    out = out.select(*rest, "_chars", "_symbols", n.cast("long").alias("_n"), n_lines.alias("_n_lines"), n_dup.alias("_n_dup"), hashes.alias("_hash"))
    kept = [*rest, "_chars", "_symbols", "_n", "_n_lines", "_n_dup"]
    repeats = F.size(F.array_distinct("_hash")) < F.size("_hash")
    out = out.select(*kept, "_hash", F.when(repeats, F.sort_array("_hash")).otherwise(F.array().cast("array<bigint>")).alias("_sorted"))
    # Equal hashes stand side by side in sorted order.
    out = out.select(*kept, "_hash", F.array_distinct(F.filter("_sorted", lambda x, k: F.coalesce(F.get("_sorted", k - 1) == x, F.lit(False)))).alias("_again"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    marked = F.transform("_hash", lambda x, k: F.struct(x.alias("h"), k.alias("i")))
    found = F.when(F.size("_again") == 0, none).when(F.size("_again") <= FEW_REPEATS, F.filter(marked, lambda x: F.array_contains("_again", x["h"]))).otherwise(F.sort_array(marked))
    out = out.select(*kept, (F.size("_again") > FEW_REPEATS).alias("_many"), found.alias("_marked"))
    beside = lambda x, k: F.coalesce(F.get("_marked", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_marked", k + 1)["h"] == x["h"], F.lit(False))
    places = lambda c: F.transform(c, lambda x: x["i"])
    out = out.select(*kept, F.when(F.col("_many"), F.sort_array(places(F.filter("_marked", beside)))).otherwise(places(F.col("_marked"))).alias("_at"))
    # A window adds the words that the window before it does not cover.
    covered = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get("_at", k - 1), F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    counts = F.struct(
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_n_lines").alias("n_lines"), F.col("_n_dup").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: filters on the counts are not pushed below it, where they would repeat the work above.
    return out.select(*rest, F.explode(F.array(counts)).alias("quality"))


def base_failed() -> Column:
    q = F.col("quality")
    return (q["n_words"] < MIN_WORDS) | (F.lit(100) * q["n_repeat_words"] > F.lit(MAX_REPEAT_PERCENT) * q["n_words"])


def rates() -> dict[str, Column]:
    """Whole numbers: per thousand words or lines, and hundredths of characters a word."""
    q = F.col("quality")
    part = lambda top, k, bottom: F.floor(q[top] * k / F.greatest(q[bottom], F.lit(1))).cast("long")
    return {
        "symbol_rate": part("n_symbols", 1000, "n_words"),
        "dup_line_rate": part("n_dup_lines", 1000, "n_lines"),
        "repeat_rate": part("n_repeat_words", 1000, "n_words"),
        "length_rate": part("word_chars", 100, "n_words"),
    }


def bin_of(value: Column) -> Column:
    """The sketch's bin: the value itself below 64, else its leading six bits and their place."""
    place = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(place * 64 + F.call_function("shiftright", value, place))


def value_of(b: Column) -> Column:
    """The least value of a bin."""
    place = F.floor((b - 32) / 64).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - place * 64, place))


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, rate, bin, n) over documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rate"), bin_of(v).cast("long").alias("bin")) for name, v in rates().items()])
    return (
        counted.filter(~base_failed())
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("p"))
        .groupBy("lang", "source", F.col("p.rate").alias("rate"), F.col("p.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Coarser sketches: those of all groups that agree in ``by``, added up."""
    return sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rate, total, most): the highest value that each rate may take."""
    # A group's histogram has a bounded number of bins, whatever its documents number.
    bins = sketch.groupBy(*by, "rate").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))
    running = F.transform("h", lambda x, k: F.struct(x["bin"].alias("bin"), F.aggregate(F.slice("h", 1, k + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("cum")))
    bins = bins.withColumn("h", running)
    quantile = lambda q: value_of(F.element_at(F.filter("h", lambda x: F.lit(100) * x["cum"] >= F.lit(q) * F.col("total")), 1)["bin"])
    bins = bins.withColumn("q25", quantile(25)).withColumn("q75", quantile(75))
    multiple, floor, ceiling = (F.element_at(F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[i])]), F.col("rate")) for i in range(3))
    return bins.select(*by, "rate", "total", F.least(F.col("q75") + multiple * (F.col("q75") - F.col("q25")) + floor, ceiling.cast("long")).alias("most"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, most_<rate>...): a row for each group that has a document passing the base rules."""
    own, wide = limits(sketch, ["lang", "source"]), limits(merge(sketch, ["lang"]), ["lang"])
    wide = wide.select(F.col("lang").alias("_lang"), F.col("rate").alias("_rate"), F.col("most").alias("_wide"))
    both = own.join(wide, own["lang"].eqNullSafe(wide["_lang"]) & (own["rate"] == wide["_rate"]))
    most = F.when(F.col("total") >= MIN_GROUP, F.col("most")).otherwise(F.col("_wide"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, most)).alias(f"most_{r}") for r in RATES])


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``quality`` (counts), ``base_failed`` and ``kept``, which replace columns of these names.

    The thresholds are made first and written to the shared checkpoint folder, so
    their size is known before the join: small tables are broadcast, others joined
    by a salted key.  Without the text the counts are written too and the texts
    are read once; with it they are counted again rather than copied to disk.
    """
    # The row travels as one struct, so that no column of ``docs`` can clash with those made here.
    rest = [c for c in docs.columns if keep_text or c != text_col]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = with_counts(inner)
    if not keep_text:
        counted = saved(counted)
    made = thresholds(sketches(counted)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    made = saved(made)
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if made.count() <= BROADCAST_ROWS:
        joined = counted.join(F.broadcast(made), on, "left")
    else:
        salted = made.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        key = F.pmod(F.hash(*[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_lines")]), F.lit(SALTS))
        joined = counted.withColumn("_key", key).join(salted, on & (F.col("_key") == F.col("_salt")), "left")
    good = ~base_failed()
    for name, value in rates().items():
        good = good & (value <= F.coalesce(F.col(f"most_{name}"), F.lit(2**62)))
    made_here = ("quality", "base_failed", "kept")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in rest if c not in made_here], "quality", base_failed().alias("base_failed"), good.alias("kept"))
