"""Ranked lexical search: item tiles times document tiles as dense matrix products with exact sums."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import kept

#: Bytes of item texts in a block, save that an item is never cut. A block is what is broadcast at once.
BLOCK = 4_000_000
#: Items of a tile, and cells of a tile of document impacts.
ITEMS, CELLS = 64, 2_000_000
#: An impact is below this, and a sum of products below the second number is exact in float64.
IMPACT, EXACT = 1_000_000, 2**53

#: Letters of A to Z in lower case, other ASCII that is no letter or digit as a blank.
FOLD = bytes(
    c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 32
    for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their term counts, `BLOCK` bytes of text at a time; the driver holds one block."""
    block, size = [], 0
    for item, text in items.toLocalIterator(prefetchPartitions=True):
        block.append((item, Counter(terms_of(text))))
        size += len(text or "")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def slabs(wanted: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut item weights (items by terms) into parts with row sums up to `most`: the terms of a part, and its weights."""
    wanted = wanted.copy()
    while wanted.any():
        before = np.cumsum(wanted, axis=1) - wanted
        part = np.minimum(np.maximum(most - before, 0), wanted)
        columns = np.flatnonzero(part.any(axis=0))
        yield columns, part[:, columns].astype(np.float64)
        wanted -= part


class Tile:
    """Up to `ITEMS` items over the terms that they have, and the best documents met so far for each."""

    def __init__(self, first: int, counts: list[dict[int, int]], weights: np.ndarray, k: int):
        self.first, self.k = first, k
        self.terms = np.array(sorted({t for c in counts for t in c}), np.int64)
        wanted = np.zeros((len(counts), len(self.terms)), np.int64)
        for i, c in enumerate(counts):
            wanted[i, np.searchsorted(self.terms, list(c))] = [n * int(weights[t]) for t, n in c.items()]
        self.slabs = list(slabs(wanted, (EXACT - 1) // IMPACT))
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.terms] = np.arange(len(self.terms))
        self.best: list[list[tuple]] = [[] for _ in counts]

    def add(self, ids: list, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Score documents `ids`, given as cells: the number of the document, the term and its impact."""
        column = self.place[terms]
        mine = column >= 0
        docs, column, impacts = docs[mine], column[mine], impacts[mine]
        step = max(1, CELLS // max(1, len(self.terms)))
        for low in range(0, len(ids), step):
            a, b = np.searchsorted(docs, [low, low + step])
            dense = np.zeros((len(self.terms), min(step, len(ids) - low)))
            dense[column[a:b], docs[a:b] - low] = impacts[a:b]
            scores = np.zeros((len(self.best), dense.shape[1]), np.int64)
            for columns, part in self.slabs:
                scores += (part @ dense[columns]).astype(np.int64)
            self._keep(ids, low, scores)

    def _keep(self, ids: list, low: int, scores: np.ndarray) -> None:
        """Ties at the last place are all compared by id before any is let go."""
        for i, best in enumerate(self.best):
            row = scores[i]
            near = np.flatnonzero(row >= (best[-1][0] if len(best) == self.k else 1))
            if len(near) > self.k:
                near = near[row[near] >= np.partition(row[near], len(near) - self.k)[len(near) - self.k]]
            if len(near):
                found = best + [(int(row[j]), ids[low + j]) for j in near]
                self.best[i] = sorted(found, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[: self.k]


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The `k` documents of highest score for each item: `item_col`, `rank` (from 1), `id_col`, `score`.

    Terms are runs of ASCII letters, digits and all other code points from U+0080 on, A to Z lower-cased. Equal scores
    rank by ascending id, null ids last; documents with score 0 are left out, so an item without known terms, with a null
    or an empty text has no rows. Repeated documents are ranked each, a repeated item is answered each time. Empty tables
    give an empty result; other columns are ignored.

    Documents are read once for each block of `BLOCK` bytes of items: only the counts of the block's terms are kept, as
    written rows. Each task multiplies its documents by all item tiles of the block and passes on `k` rows per item.
    """
    seen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    asked = items.select(items[item_col].alias("item"), items[item_text_col].cast("string").alias("text"))
    out = T.StructType([T.StructField("at", T.IntegerType()), seen.schema["id"], T.StructField("score", T.LongType())])
    item_type = T.StructType([T.StructField("at_", T.IntegerType()), asked.schema["item"]])
    spark, parts = docs.sparkSession, []
    for block in _blocks(asked):
        found = _block(seen, [c for _, c in block], k, out)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], item_type)
        order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), F.col("at") == F.col("at_")))
    named = [F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"]
    if not parts:
        return spark.createDataFrame([], T.StructType([*out.fields, *item_type.fields, T.StructField("rank", T.IntegerType())])).select(*named)
    return reduce(DataFrame.union, [p.select(*named) for p in parts])


def _block(docs: DataFrame, counts: list[Counter], k: int, schema: T.StructType) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted(set().union(*counts))
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = kept(docs.mapInArrow(_counting(shared), T.StructType([docs.schema["id"], *_COUNTED])))
    totals = rows.agg(F.count("*").alias("n"), F.sum("n").alias("all")).first()
    held = np.zeros(len(terms), np.int64)
    for term, n in rows.select("terms").mapInArrow(_holding, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        held[term] = n
    # a row per term of the block
    weights = np.array([math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    numbered = [{shared.value[t]: n for t, n in c.items()} for c in counts]
    setting = spark.sparkContext.broadcast((numbered, weights, totals["n"], totals["all"], k))
    return rows.mapInArrow(_ranking(setting), schema)


_COUNTED = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]


def _counting(shared):
    """Rows of documents with terms: how many, and which of the block's terms how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            rows, n, terms, tf, ends = [], [], [], [], [0]
            for i, text in enumerate(b.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    terms += found
                    tf += found.values()
                    rows.append(i)
                    n.append(len(words))
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each term."""
    held = np.zeros(0, np.int64)
    for b in batches:
        more = np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(held))
        more[: len(held)] += held
        held = more
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["term", "n"])


def _ranking(setting):
    """The best rows of the task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, n_docs, n_terms, k = setting.value
        tiles = [Tile(i, counts[i : i + ITEMS], weights, k) for i in range(0, len(counts), ITEMS)]
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            sizes = np.diff(b.column(2).offsets.to_numpy())
            docs = np.repeat(np.arange(b.num_rows), sizes)
            terms = b.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column(1).to_numpy(zero_copy_only=False)
            m = 25 + (75 * n * n_docs) // n_terms
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
            ids = b.column(0).to_pylist()
            for tile in tiles:
                tile.add(ids, docs, terms, impacts)
        found = [(tile.first + i, name, score) for tile in tiles for i, best in enumerate(tile.best) for score, name in best]
        if found:
            at, names, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(names, id_type), pa.array(scores, pa.int64())], ["at", "id", "score"])

    return run
