"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Each coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so that the model is a
short list of places and weights with a size bound of `BITS`. It is fitted on a bounded sample of labelled rows in
`ROUNDS` rounds: each task runs FTRL over its rows from the shared state, and the changes of a coordinate are averaged
over the tasks that met it. All documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import kept, whole
from tallyscope.llm.pieces import Kept

#: Features are hashed to 2**BITS places, which bounds the state and the model.
BITS = 18
#: Words from one word of a feature to the other: bigrams, and skip-grams over one and two words.
GAPS = (1, 2, 3)
#: At most so many labelled rows of either label are fitted on, taken by a hash of their ids.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
ROUNDS, SHARDS = 3, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
#: Odd multipliers for the hashes of word pairs, one for each gap.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def _word_hash(word: str) -> int:
    return zlib.crc32(word.strip(".,;:!?\"'()*#$%&|<>").encode()) if word else 0


_hashes = Kept(_word_hash)


def places_of(texts: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and place of each of its features, each once and in order; only `used` places if given.

    Place 0 is the bias, which every text has once.
    """
    words = [t.lower().split() for t in texts]
    sizes = [len(w) for w in words]
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    found = [np.arange(len(texts)) << BITS]
    for k, gap in enumerate((0, *GAPS)):
        mixed = h * MIX[0] if not gap else h[:-gap] * MIX[k] + h[gap:] * MIX[0] + np.uint64(gap)
        place = ((mixed & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)).astype(np.int64)
        of = text[gap:]
        keep = text[: len(text) - gap] == of
        if used is not None:
            keep &= used[place]
        found.append((of[keep] << BITS) + place[keep])
    keys = np.unique(np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _portions(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of some million characters, with their texts."""
    at, texts, size = 0, [], 0
    for k, t in enumerate(b.column(column)):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size > 2_000_000 or k + 1 == b.num_rows:
            yield b.slice(at, k + 1 - at), texts
            at, texts, size = k + 1, [], 0


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that a state of gradients' sums and squares stands for."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(w: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(w, -35.0, 35.0))))


def fitted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights, from rows of `text` and `y`. Without rows there are no weights."""
    spark = rows.sparkSession
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _portions(batch, 0):
                of, place = places_of(texts)
                starts = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, b.column(1), b.column(2)], ["at", "y", "o"])

    given = rows.select("text", F.col("y").cast("double").alias("y"), F.xxhash64("text").alias("o"))
    made = given.mapInArrow(featured, "at array<int>, y double, o long")
    dealt = kept(made.repartition(SHARDS, F.pmod("o", F.lit(SHARDS))).sortWithinPartitions("o"))
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def changes(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            z, n = (x.copy() for x in state.value)
            for b in batches:
                ends, flat = b.column(0).offsets.to_numpy(), b.column(0).values.to_numpy()
                for k, y in enumerate(b.column(1).to_pylist()):
                    at = flat[ends[k] : ends[k + 1]]
                    zi, ni = z[at], n[at]
                    w = weights_of(zi, ni)
                    g = probability(w.sum()) - y
                    z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                    n[at] = ni + g * g
            dz, dn = z - state.value[0], n - state.value[1]
            at = np.flatnonzero(dn)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, dz[at], dn[at])], ["at", "dz", "dn"])

        got = dealt.select("at", "y").mapInArrow(changes, "at long, dz double, dn double").groupBy("at").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()
        at = got.column("at").to_numpy()  # at most 2**BITS rows
        z[at] += got.column("dz").to_numpy()
        n[at] += got.column("dn").to_numpy()
        state.unpersist()
    w = weights_of(z, n)
    places = np.flatnonzero(w)
    return places, w[places]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and `score` from 0 to 1. A null or empty text has the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = whole(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS)
        weight[shared.value[0]] = shared.value[1]
        used = weight != 0
        for batch in batches:
            for b, texts in _portions(batch, 1):
                of, place = places_of(texts, used)
                sums = np.bincount(of, weight[place], len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["id", "score"])

    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """The fixed fold that labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """One row per document: id, `held_out`, `score` and `predicted` (1 from `threshold` on).

    Learns from at most `max_toxic` and `max_clean` labelled rows outside the held-out fold. Null labels are left out, of several labels of
    an id the highest counts, repeated documents are scored each; without labels all scores are 0.5; other columns are
    ignored.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).dropna()
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    known = known.withColumn("y", F.when(F.col("y") > 0, 1).otherwise(0))
    first = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    known = first(1, max_toxic).unionByName(first(0, max_clean))
    # at most max_toxic + max_clean rows of an id and a number; texts are not shuffled to find them
    rows = whole(docs, id_col, text_col).join(F.broadcast(known), "id")
    out = scored(docs, fitted(rows), id_col, text_col)
    held = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
