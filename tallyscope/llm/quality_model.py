"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of all vote
patterns estimates how accurate each is and how good the corpus, without any true label; the posterior of its pattern is
a document's soft label, and a hashed linear model learns these from the shapes of words, so it also judges documents on
which nobody votes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import BLANK, kept, whole, word_array
from tallyscope.llm.quality_rules import STOP_WORDS
from tallyscope.llm.toxicity import fitted, scored

#: The model is fitted on at most so many documents with a vote, those with the lowest hashes of their ids.
MAX_ROWS = 16_000
ROUNDS = 60
#: Votes in percent: measure, bad below, good from, good to, bad above (None: no vote on that side).
LABELLERS = {
    "words": ("n_words", 10, 60, None, None),
    "word_size": ("100 * chars / n_words", 300, 420, 650, 900),
    "symbols": ("100 * n_symbols / n_words", None, 0, 2, 15),
    "exclamations": ("100 * n_bangs / n_words", None, 0, 3, 30),
    "stop_words": ("100 * n_stop / n_words", 4, 12, None, None),
    "repeats": ("100 * n_distinct / n_words", 25, 45, None, None),
    "lines": ("100 * n_distinct_lines / n_lines", 50, 80, None, None),
    "capitals": ("100 * n_capitals / chars", None, 0, 6, 30),
}


def _vote(measure: str, bad_below, good_from, good_to, bad_above) -> Column:
    v = F.expr(measure)
    bad = [v < bad_below] * (bad_below is not None) + [v > bad_above] * (bad_above is not None)
    good = [v >= good_from] * (good_from is not None) + [v <= good_to] * (good_to is not None)
    either, all_ = bad[0], good[0]
    for x in bad[1:]:
        either = either | x
    for x in good[1:]:
        all_ = all_ & x
    return F.when(either, 0).when(all_, 1).otherwise(2)


def _measured(rows: DataFrame) -> DataFrame:
    """`id`, `votes` as text (0 bad, 1 good, 2 nothing) and `shapes`, the text with words reduced to what they look like."""
    t = F.col("text")
    count = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", ""))
    rows = rows.select("id", "text", word_array(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANK}]")).alias("l"))
    rows = rows.select(
        "id", "text", F.size("w").alias("n_words_"), F.greatest(F.size("w"), F.lit(1)).alias("n_words"),
        F.greatest(F.length(F.array_join("w", "")), F.lit(1)).alias("chars"), count("#*$%&|<>").alias("n_symbols"), count("!").alias("n_bangs"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).alias("n_stop"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.greatest(F.size("l"), F.lit(1)).alias("n_lines"), F.greatest(F.size(F.array_distinct("l")), F.lit(1)).alias("n_distinct_lines"),
        count("A-Z").alias("n_capitals"),
    )
    votes = F.concat(*[_vote(*rule).cast("string") for rule in LABELLERS.values()])
    marks = [F.concat(F.lit(f"{name}_"), F.floor(F.expr(rule[0]) / 10).cast("string")) for name, rule in LABELLERS.items() if name != "words"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9")
    votes = F.when(F.col("n_words_") == 0, F.lit("0" + "2" * (len(LABELLERS) - 1))).otherwise(votes)
    return rows.select("id", votes.alias("votes"), F.concat_ws(" ", *marks, shape).alias("shapes"))


def label_model(patterns: list[str], counts: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of being good by pattern, the share of good documents, and per labeller the chances of each vote.

    The chances are those of votes 0, 1, 2 given a bad and given a good document; they start from labellers that are right
    four times in five.
    """
    votes = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(counts, float)
    k = votes.shape[1]
    silent = np.stack([(n[:, None] * (votes == 2)).sum(0), np.zeros(k)])[0] / n.sum()
    chance = np.empty((k, 2, 3))
    for y in (0, 1):
        chance[:, y, y], chance[:, y, 1 - y], chance[:, y, 2] = 0.8 * (1 - silent), 0.2 * (1 - silent), silent
    prior, post = 0.7, None
    for _ in range(rounds):
        logs = np.log(np.maximum(chance, 1e-9))
        by_class = np.stack([sum(logs[j, y, votes[:, j]] for j in range(k)) for y in (0, 1)]) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(by_class[0] - by_class[1], -50, 50)))
        prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            for v in range(3):
                chance[:, y, v] = ((weight[:, None] * (votes == v)).sum(0) + 1) / (weight.sum() + 3)
    return post, prior, chance


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: id, `votes`, `posterior` of its vote pattern, the model's `score`, and `kept` (score from `threshold`).

    Null and empty texts have no words, which one labeller calls bad. Repeated rows are judged each, other columns are
    ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = kept(_measured(whole(docs, id_col, text_col)))  # measured once, used by three passes
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** labellers rows
    if not counted:
        none = F.lit(0.0)
        return rows.select(F.col("id").alias(id_col), "votes", none.alias("posterior"), none.alias("score"), F.lit(False).alias("kept"))
    post, _, _ = label_model([r["votes"] for r in counted], [r["n"] for r in counted])
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(counted, post, strict=True)], "votes string, posterior double")
    labelled = rows.join(F.broadcast(table), "votes")
    chosen = labelled.filter(F.col("votes") != "2" * len(LABELLERS))
    order = F.xxhash64("id", "votes")
    last = chosen.select(order.alias("o")).orderBy("o").limit(max_rows).agg(F.max("o")).head()[0]
    model = fitted(chosen.filter(order <= F.lit(last)).select(F.col("shapes").alias("text"), F.col("posterior").alias("y")))
    packed = labelled.select(F.struct("id", "votes", "posterior").alias("row"), "shapes")
    out = scored(packed, model, "row", "shapes")
    return out.select(F.col("row.id").alias(id_col), "row.votes", "row.posterior", "score", (F.col("score") >= threshold).alias("kept"))


