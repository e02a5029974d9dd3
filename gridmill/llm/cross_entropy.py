"""Cross-entropy difference of a target and a background model.

Both are bigram models of words over one vocabulary, every token of the corpus, of
one order, smoothing and size (``word_models``): the target's from all trusted
labelled texts, the background's from all documents, scaled to the target's size.
A document's score is the mean over its tokens (its end is one) of the target's
loss minus the background's; low scores are more like the target.

Null and empty texts have no tokens and score 0.  Repeated rows count as often
as they occur and get equal scores.  Long texts are a block of their own.  Without
target texts the target is the background's unigram model.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import word_models
from gridmill.llm.quality_kneser_ney import good_ids
from gridmill.llm.shared import saved

#: Up to so many trusted ids (16 bytes each) are broadcast; beyond, the join shuffles the texts.
BROADCAST_IDS = 2_000_000


def score(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference): losses a token in nats, of every row of ``docs``."""
    return word_models.losses(docs, target, text_col).withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def score_against_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The target is every document labelled as good."""
    good = saved(good_ids(labels).select("doc_id").distinct())
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return score(docs, docs.join(good, "doc_id", "left_semi").select("doc_id", "text"))
