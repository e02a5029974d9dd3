"""Quality classifier: perplexity under a model of trusted text.

A modified Kneser-Ney model of characters (``ngram``) is trained on texts labelled
as good and not toxic, all of them but one in ``CALIBRATION``, chosen by a hash of the
id, which is kept out of the training to set the thresholds.  ``crossed`` does both
with all of them: the model counts every trusted text, and every trusted text sets the
thresholds by its loss under a model of the texts of the other ``CALIBRATION`` - 1 parts.
A document's ``score`` is its perplexity after ``PRIOR_TOKENS`` further characters
at its language's median loss, because a few words say little.  A document is
rejected if its score is above its language's threshold: the ``QUANTILE`` of the
scores of the language's texts that were kept out, times ``SLACK``.

Null and empty texts are kept with perplexity 1: there is nothing to reject.
A language (null is one) without ``MIN_TRUSTED`` texts that set thresholds uses the
threshold of all.  Without any nothing is rejected.  Quantiles are exact and do not depend on the
order of rows.  Repeated rows get equal results, an empty
table gives an empty one, and a long text is a block of its own.  Columns of
``keep`` that clash with those made here come under their names with ``kept_``
before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import ngram
from gridmill.llm.shared import release, saved

#: Up to so many trusted ids (16 bytes each) are broadcast; beyond, the join shuffles the texts.
BROADCAST_IDS = 2_000_000
CALIBRATION = 4
PRIOR_TOKENS = 200
QUANTILE = 0.99
SLACK = 1.15
MIN_TRUSTED = 20
#: Values of a nat are counted in so many bins before a quantile is looked for in one of them.
BINS = 256
MADE = ("n_tokens", "perplexity", "score", "threshold", "kept")


def good_ids(labels: DataFrame) -> DataFrame:
    """The labels of documents labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Every id labelled good and not toxic, once, and its part of ``CALIBRATION``; ``held`` for the first part, which sets the thresholds unless they are crossed."""
    some = good_ids(labels).select("doc_id").distinct().withColumn("part", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(CALIBRATION)))
    return some.select("doc_id", "part", (F.col("part") == 0).alias("held"))


def _mean_loss() -> Column:
    return F.col("loss") / F.greatest(F.col("n_tokens"), F.lit(1))


def _score(middle: Column) -> Column:
    """Mean loss after adding PRIOR_TOKENS tokens of the middle loss."""
    return (F.col("loss") + F.lit(PRIOR_TOKENS) * middle) / (F.col("n_tokens") + F.lit(PRIOR_TOKENS))


def _quantile(values: DataFrame, q: float) -> DataFrame:
    """(lang, whole, n, at): how many rows of (lang, whole, value) each group has, and their exact quantile, interpolated between neighbours.

    The rows are counted by bins first, so that one task gets the values of one bin and not of a language.
    """
    group = ["lang", "whole"]
    binned = values.withColumn("bin", F.floor(F.col("value") * BINS))
    upto, every = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group)
    bins = binned.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("n", F.sum("c").over(every))
    place = F.lit(q) * (F.col("n") - 1)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    near = lambda rows: rows.filter(holds(F.floor(place)) | holds(F.ceil(place)))
    # At most two bins a language that has MIN_TRUSTED texts.
    picked = near(bins.filter((F.col("n") >= MIN_TRUSTED) | F.col("whole")))
    inner = binned.alias("a").join(F.broadcast(picked.alias("b")), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "bin")])
    inner = inner.groupBy(*[F.col(f"b.{c}") for c in (*group, "bin", "before", "n")], "a.value").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = near(inner.withColumn("before", F.col("before") + F.sum("c").over(within) - F.col("c")))
    return ends.groupBy(*group, "n").agg((F.min("value") + (F.max("value") - F.min("value")) * F.max(place - F.floor(place))).alias("at"))


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, mid, most): the median and the highest mean loss of each language with enough trusted texts, and of all as (null, true)."""
    usable = saved(scored.filter(F.col("n_tokens") > 0).select("lang", "n_tokens", "loss"))
    each = F.array(F.struct(F.col("lang").alias("lang"), F.lit(False).alias("whole")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("whole")))
    dealt = usable.withColumn("g", F.explode(each)).select("g.*", "n_tokens", "loss")
    mids = saved(_quantile(dealt.select("lang", "whole", _mean_loss().alias("value")), 0.5).withColumnRenamed("at", "mid"))
    on = [F.col("a.lang").eqNullSafe(F.col("b.lang")), F.col("a.whole") == F.col("b.whole")]
    scores = dealt.alias("a").join(F.broadcast(mids.alias("b")), on).select("a.lang", "a.whole", _score(F.col("mid")).alias("value"))
    tops = _quantile(scores, QUANTILE).alias("a").join(F.broadcast(mids.alias("b")), on)
    return tops.select("a.lang", "a.whole", "mid", (F.col("at") + F.log(F.lit(SLACK))).alias("most"))


def crossed_losses(trusted: DataFrame) -> tuple[ngram.Model, DataFrame]:
    """The model of all texts (columns doc_id, lang, text, part), and (lang, n_tokens, loss) of each text under the model of the other parts."""
    # Read twice, and in blocks of one part.
    trusted = saved(trusted.sortWithinPartitions("part"))
    every = ngram.model(ngram.count(trusted, group_col="part", groups=CALIBRATION))
    release(trusted.sparkSession)
    others = every.of(*[f"without_{i}" for i in range(CALIBRATION)])
    # A text is not judged by a model that has seen nothing.
    judged = trusted.filter(F.col("part").isin([i for i, none in enumerate(others.empty) if not none]))
    scored = ngram.losses(judged, others, keep=("lang",), group_col="part", ordered=True)
    return every.of("n"), scored.select("lang", "n_tokens", "loss")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text", crossed: bool = False) -> DataFrame:
    """(doc_id, *keep, n_tokens, perplexity, score, threshold, kept) of every row of ``docs`` (columns doc_id, lang, text)."""
    ids = saved(trusted_ids(labels))
    near = F.broadcast if ids.count() <= BROADCAST_IDS else lambda some: some
    texts = docs.select("doc_id", F.col(text_col).alias("text"), F.col("lang").cast("string").alias("lang"))
    among = lambda which: texts.join(near(ids.filter(which)), "doc_id", "left_semi")
    if crossed:
        model, tried = crossed_losses(texts.join(near(ids.select("doc_id", "part")), "doc_id"))
    else:
        model = ngram.model(ngram.count(among("not held")))
        tried = ngram.losses(among("held"), model, keep=("lang",))
    # A language has its row for MIN_TRUSTED texts that were tried; (null, true) is there if any text is.
    bars = F.broadcast(saved(thresholds(tried)))
    del tried
    release(docs.sparkSession)
    narrow = docs.select("doc_id", F.col(text_col).alias("_text"), F.struct(F.col("lang").cast("string").alias("lang"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep) if k != text_col]).alias("_row"))
    scored = ngram.losses(narrow, model, text_col="_text", keep=("_row", *["_text"] * (text_col in keep)))
    own, every = bars.filter("not whole"), bars.filter("whole")
    scored = scored.join(own.select(F.col("lang").alias("_lang"), F.col("mid").alias("_mid"), F.col("most").alias("_most")), F.col("_row.lang").eqNullSafe(F.col("_lang")), "left")
    scored = scored.join(every.select(F.col("mid").alias("_mid_all"), F.col("most").alias("_most_all")), F.lit(True), "left")
    middle, most = F.coalesce("_mid", "_mid_all", F.lit(0.0)), F.coalesce("_most", "_most_all", F.lit(float("inf")))
    value = F.when(F.col("n_tokens") > 0, _score(middle)).otherwise(0.0)
    names = [f"kept_{k}" if k in MADE else k for k in keep]
    columns = [F.col("_text" if k == text_col else f"_row.k{i}").alias(n) for i, (k, n) in enumerate(zip(keep, names, strict=True)) if k != "doc_id"]
    kept = (F.col("n_tokens") == 0) | (value <= most)
    return scored.select("doc_id", *columns, "n_tokens", F.exp(_mean_loss()).alias("perplexity"), F.exp(value).alias("score"), F.exp(most).alias("threshold"), kept.alias("kept"))
