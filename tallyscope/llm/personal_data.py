"""Personal data by bootstrapped contextual extraction, in built-in functions only.

Seeds are the spans of four fixed expressions. The words before a span form a lexical pattern; a pattern that mostly
stands before known entities is trusted, what else it stands before becomes known, and so on for a few rounds over the
graph of patterns and instances, which Spark keeps as counts. Trusted patterns then add the unseen identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import BLANK, fresh, kept

#: The kinds in the order that ties of `start` are listed in; what the patterns add comes last.
KINDS = ("email", "ip", "card", "phone", "context")
#: The seeds' expressions. Each begins only where a run of its first characters begins or where the match before ended,
#: which is where a search from the left finds it; possessive repeats give the same matches and never go back, so texts
#: of any shape are read in linear time. A card is a whole run of 14 to 19 digits, so no shorter run is looked at.
LOCAL = "A-Za-z0-9._%+-"
SEEDS = {
    "email": f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheaper look that every text with a match passes.
LOOKS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": SEEDS["card"], "phone": r"\+[0-9]"}
#: What a pattern may stand before: a whole run with a digit or an at sign, of any length, up to its last letter or digit.
#: A run has one place to begin, so it is read a fixed number of times.
MARKS = r"()\[\]\"'<>,;=:"
INSTANCE = f"(?<![^{BLANK}(\\[\"'<=:])(?=[^{BLANK}{MARKS}]*[0-9@])[^{BLANK}{MARKS}]{{4}}[^{BLANK}{MARKS}]*[A-Za-z0-9]"
#: A pattern: the two words before, in lower case, with nothing but white space or an opening mark up to the instance.
BEFORE = f"([^{BLANK}]+[{BLANK}]+[^{BLANK}]+?)[{BLANK}(\\[\"'<]*$"
REACH = 120
#: Instances of more characters are counted by their hash, so that no long text is shuffled as a key.
LONG = 64
ROUNDS = 3
#: A pattern is trusted if known instances follow it so often, and in so large a share of its places.
SUPPORT, CONFIDENCE = 3, 0.6

SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of `x` pass the check sum: every second one from the right doubled, 9 off if it is over 9."""
    places = F.filter(F.split(F.reverse(_digits(x)), ""), lambda d: d != "")
    values = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(x, "\\."), lambda p: F.ltrim(p, F.lit("0")).rlike(part))
    if kind == "card":
        return _luhn(x)
    return F.length(_digits(x)).between(10, 15) if kind == "phone" else F.lit(True)


def _placed(text: Column, pattern: str, rank: int) -> Column:
    """Places of a pattern's matches: what lies between them and the matches themselves, laid end to end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))

    def put(a: Column, x: Column) -> Column:
        s = a["at"] + x["b"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), F.lit(rank).alias("k"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(pairs, start, put, lambda a: a["out"])


def _seeds(text: str) -> Column:
    """All seed spans of a text, by start and kind."""
    none = F.array().cast(SPAN)
    t = F.col(text)

    def of(rank: int, kind: str) -> Column:
        look = t.contains("@") if kind == "email" else t.rlike(LOOKS[kind])
        return F.when(look, F.filter(_placed(t, SEEDS[kind], rank), lambda x: _holds(kind, x["m"]))).otherwise(none)

    each = [of(rank, kind) for rank, kind in enumerate(KINDS[:4])]
    return F.when(t.rlike("[0-9@]"), F.sort_array(F.concat(*each))).otherwise(none)


def _with_pattern(text: str, spans: Column) -> Column:
    """Spans with the pattern before each, '' if there is none; a long `m` becomes a hash, which no instance can look like."""
    low = F.lower(F.col(text))

    def named(x: Column) -> Column:
        first = F.greatest(x["s"] - REACH, F.lit(0))
        words = F.regexp_extract(F.substring(low, first + 1, x["s"] - first), BEFORE, 1)
        key = F.when(F.length(x["m"]) > LONG, F.concat(F.lit("# "), F.sha2(x["m"], 256))).otherwise(x["m"])
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), key.alias("m"), F.regexp_replace(words, f"[{BLANK}]+", " ").alias("p"))

    return F.transform(spans, named)


def _found(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base`, the seed spans, and `cands`, seeds and other instances with the pattern before each. Narrow."""
    low = F.regexp_replace(F.lower(F.col(text)), f"[{BLANK}]+", " ")
    rows = rows.withColumn("base", _seeds(text))
    free = F.filter(_placed(F.col(text), INSTANCE, 4), lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])))
    rows = rows.withColumn("free", F.when(F.col(text).rlike("[0-9@]"), free).otherwise(F.array().cast(SPAN)))
    rows = rows.withColumn("cands", F.filter(_with_pattern(text, F.concat("base", "free")), lambda x: x["p"] != ""))
    rows = rows.withColumn("flat", F.when(F.size("cands") > 0, low))
    # how often each pattern stands in the text: what taking it out shortens the text by
    counts = F.transform(
        F.array_distinct(F.transform("cands", lambda x: x["p"])),
        lambda p: F.struct(p.alias("p"), F.floor((F.length("flat") - F.length(F.replace(F.col("flat"), p, F.lit("")))) / F.length(p)).alias("n")),
    )
    return rows.withColumn("counts", F.when(F.size("cands") > 0, counts)).drop("flat", "free")


def _trusted(found: DataFrame) -> DataFrame:
    """The patterns that are trusted after the last round, from `cands` and `counts` of all documents."""
    edges = found.select(F.explode("cands").alias("c")).select(F.col("c.p").alias("p"), F.col("c.m").alias("m"), (F.col("c.k") < 4).alias("seed"))
    edges = kept(edges.groupBy("p", "m").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    places = found.select(F.explode("counts").alias("c")).groupBy(F.col("c.p").alias("p")).agg(F.sum("c.n").alias("places"))
    # patterns with too few instances of any kind can never be trusted, whatever is learnt
    able = edges.groupBy("p").agg(F.sum("n").alias("all")).filter(F.col("all") >= SUPPORT)
    able = kept(able.join(places, "p").filter(F.col("all") >= CONFIDENCE * F.col("places")).select("p", "places"))
    known = kept(edges.join(able, "p", "left_semi"))  # instances and what is known of them, in patterns that may count
    trusted = None
    for _ in range(ROUNDS):
        held = known.filter("seed").groupBy("p").agg(F.sum("n").alias("known"))
        now = held.join(able, "p").filter((F.col("known") >= SUPPORT) & (F.col("known") >= CONFIDENCE * F.col("places"))).select("p")
        trusted = kept(now)
        learnt = known.join(trusted, "p", "left_semi").select("m", F.lit(True).alias("more")).distinct()
        known = kept(known.join(kept(learnt), "m", "left").select("p", "m", "n", (F.col("seed") | F.coalesce("more", F.lit(False))).alias("seed")))
    return trusted


def _added(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """By `id` and `hash` of a text, the spans that trusted patterns add."""
    free = found.select("id", "hash", F.explode("cands").alias("c")).filter(F.col("c.k") == 4)
    free = free.select("id", "hash", F.col("c.p").alias("p"), F.struct(*[F.col(f"c.{x}").alias(x) for x in "skem"]).alias("x"))
    return free.join(trusted, "p", "left_semi").groupBy("id", "hash").agg(F.collect_set("x").alias("more"))


def _searched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """What is found in each text, without the text itself and written once, and the spans that patterns add."""
    d = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = kept(_found(d.withColumn("hash", F.xxhash64("text"))).drop("text"))
    return found, _added(found, _trusted(found))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _all_spans(spans: Column) -> Column:
    return F.sort_array(F.concat(spans, F.coalesce("more", F.array().cast(SPAN))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the number of spans of each seed kind, `base_sha256` over the seed spans, and all `spans`.

    Spans are `kind:start:end` in code points, by start and kind, joined by commas. Null and empty texts have none.
    Repeated rows each get their spans, other columns are ignored, an empty table gives an empty one.
    """
    found, added = _searched(docs, id_col, text_col)
    out = found.join(added.withColumnsRenamed({"id": "id_", "hash": "hash_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "left")
    ranks = F.transform("base", lambda x: x["k"])
    numbers = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return out.select(F.col("id").alias(id_col), *numbers, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_all_spans(F.col("base"))).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All documents and columns, each span in the text replaced by its kind in brackets; `length_col` gets the new length.

    A span that begins inside one already replaced goes with it. Null texts stay null.
    """
    _, added = _searched(docs, id_col, text_col)
    hash_, base, more_id, more_hash, more = fresh(docs, "hash_", "base_", "more_id", "more_hash", "more")
    rows = docs.withColumn(hash_, F.xxhash64(F.coalesce(docs[text_col], F.lit("")))).withColumn(base, _seeds(text_col))
    extra = added.select(F.col("id").alias(more_id), F.col("hash").alias(more_hash), F.col("more").alias(more))
    rows = rows.join(extra, F.col(id_col).eqNullSafe(F.col(more_id)) & (F.col(hash_) == F.col(more_hash)), "left")
    spans = F.sort_array(F.concat(F.coalesce(F.col(base), F.array().cast(SPAN)), F.coalesce(F.col(more), F.array().cast(SPAN))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text_col)

    def put(a: Column, x: Column) -> Column:
        new = x["s"] >= a["at"]
        piece = F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.get(marks, x["k"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(new, piece).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.when(F.size(spans) == 0, t).otherwise(F.aggregate(spans, start, put, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))))
    columns = [text.alias(c) if c == text_col else F.coalesce(F.length(text), docs[c]).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns)
