"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import BLANK, fresh, whole, word_array

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    (
        "the of and to in a is that for it on as with was be by at this are from "
        "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
        "de la le et les un du une que est pour qui dans en "
        "el y los se las por con para su al lo como"
    ).split()
)
SYMBOLS = r"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if `part` is at least `low` and at most `high` percent of `of`; only from `of` >= `least` on."""

    name: str
    part: str
    of: str
    low: int | None = None
    high: int | None = None
    least: int = 1


#: The verdict beyond the base rules. Shares are compared as whole numbers, so no rounding decides.
RULES = (
    Rule("mean_word", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_bangs", "n_words", high=40),
    Rule("stop_words", "n_stop", "n_words", low=4, least=60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50, least=6),
    Rule("bullet_lines", "n_bullets", "n_lines", high=90, least=4),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=50, least=4),
)
#: Counts that the rules may name, beside n_words and n_lines.
COUNTS = ("word_chars", "n_symbols", "n_bangs", "n_stop", "n_lines", "n_dup_lines", "n_bullets", "n_cut_lines")


def base_failed_sql() -> str:
    return "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table of rules as one boolean expression, which both Spark and other SQL engines read."""
    tests = []
    for r in rules:
        held = [f"100 * {r.part} >= {r.low} * {r.of}"] * (r.low is not None)
        held += [f"100 * {r.part} <= {r.high} * {r.of}"] * (r.high is not None)
        tests.append(f"({r.of} < {r.least} OR ({' AND '.join(held)}))")
    return " AND ".join(tests)


def _measured(docs: DataFrame, keep: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """`keep` and the counts of each text. One narrow projection; the steps only name values used more than once."""
    c, q = F.col, F.expr
    kept_chars = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    stops = F.filter("w__", lambda w: w.isin(*STOP_WORDS))
    # windows are compared within one text by 64-bit hashes of their words' hashes; the last four are shorter and equal to none
    gram = ", ".join(["x", *[f"get(h__, i + {k})" for k in range(1, WINDOW)]])
    steps = docs.select(*keep, c(text), word_array(c(text)).alias("w__"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]")).alias("l__"))
    steps = steps.select(
        *keep, c(text), "w__", F.size("w__").alias("n_words"), F.size("l__").alias("n_lines"),
        F.length(F.array_join("w__", "")).cast("long").alias("word_chars"),
        kept_chars(SYMBOLS).cast("long").alias("n_symbols"), kept_chars("!").alias("n_bangs"),
        F.size(stops).alias("n_stop"),
        (F.size("l__") - F.size(F.array_distinct("l__"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("l__", lambda x: x.rlike(f"^[{BLANK}]*[-*\\u2022][{BLANK}]"))).alias("n_bullets"),
        F.size(F.filter("l__", lambda x: x.rlike(f"(\\.\\.\\.|\\u2026)[{BLANK}]*$"))).alias("n_cut_lines"),
    )
    steps = steps.withColumn("h__", q("transform(w__, x -> xxhash64(x))"))
    steps = steps.withColumn("g__", q(f"transform(h__, (x, i) -> xxhash64({gram}))"))
    steps = steps.withColumn("t__", q("size(array_distinct(g__)) < size(g__)"))
    steps = steps.withColumn("g__", q("CASE WHEN t__ THEN sort_array(transform(g__, (x, i) -> struct(x AS g, i AS p))) END"))
    steps = steps.withColumn("s__", q("sort_array(transform(filter(g__, (x, j) -> coalesce(x.g = get(g__, j - 1).g, false) OR coalesce(x.g = get(g__, j + 1).g, false)), x -> x.p))"))
    covered = f"aggregate(transform(s__, (p, j) -> least({WINDOW}, coalesce(get(s__, j + 1) - p, {WINDOW}))), 0, (a, x) -> a + x)"
    steps = steps.withColumn("n_repeat_words", q(f"CAST(coalesce({covered}, 0) AS BIGINT)"))
    steps = steps.withColumn("n_words", c("n_words").cast("long")).withColumn("base_failed", q(base_failed_sql()))
    return steps.withColumn("kept", q(f"NOT base_failed AND {verdict_sql(rules)}"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, counts, `base_failed` and `kept`.

    Equal windows are found by 64-bit hashes within one document: with 10**4 words, a chance of 3e-12 to count one too many.

    Null and empty texts have no words, so they fail; repeated rows are judged each for itself; an empty table gives an
    empty report; other columns are ignored. Texts of any length are one row of one narrow task.
    """
    out = _measured(whole(docs, id_col, text_col), ["id"], "text", rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *counts, "base_failed", "kept", *[x for x in COUNTS if x not in counts])


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns as they are; a null text does not pass."""
    row, text = fresh(docs, "row", "body")
    packed = docs.select(F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias(row), F.coalesce(docs[text_col], F.lit("")).alias(text))
    # a column that is drawn beside the verdict keeps the filter from being moved below the counts and repeating them
    judged = _measured(packed, [row], text, rules).select(row, "kept", F.rand(1).alias("r__"))
    return judged.filter("kept AND r__ >= 0").select(f"{row}.*")
