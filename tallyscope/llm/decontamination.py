"""Benchmark decontamination by latent semantic retrieval.

Every text is cut into overlapping passages, and the frequencies of the terms that tell items apart are counted over all
of them. A distributed randomised SVD of the TF-IDF matrix of all passages gives a latent space, in which every passage is
held against every item; the items near to a passage by cosine are its candidates. A candidate is a leak if the longest
common subsequence of words covers enough of what could be covered, or if it covers less, as a paraphrase does, but the
item's rarest terms, which answer it, stand in the document's matching passages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import fresh, kept, whole

#: Words of a passage and from one to the next: a run of 17 words always lies whole in one.
PASSAGE, STRIDE = 32, 16
#: Terms in a larger share of the items say nothing about any of them.
COMMON_SHARE = 0.025
#: An item that has fewer terms of its own is known by all its words.
TERMS = 3
#: Singular vectors beside one for each item, oversampling, and power iterations.
RANK, OVERSAMPLED, POWER = 32, 16, 1
#: Cosine of a candidate; shares of the longest common subsequence that decide, alone and with the answer terms.
COSINE, COVERED, COVERED_WITH_ANSWER, ANSWER_TERMS, ANSWERED = 0.3, 0.6, 0.5, 6, 0.6
#: Items of a block, which bounds what is broadcast and the size of the matrices; more are several passes.
ITEMS = 1_000
#: Words of texts and passages that are worked on at once; neither changes a result.
SLICE, ROWS = 1 << 18, 4_000


#: Punctuation of ASCII separates words.
MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(MARKS).split()


class Benchmark:
    """The items' words by number, and the terms that tell items apart: a word in more than `COMMON_SHARE` of them does not."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = [split_words(t or "") for _, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        self.size = len(self.number)
        shares = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.unique, self.words)]), minlength=self.size)
        own = shares <= max(1, COMMON_SHARE * len(items))
        of = []
        for w in self.words:
            terms = np.unique(w[own[w]])
            of.append(terms if len(terms) >= TERMS else np.unique(w))
        self.terms_of = of
        #: Whether a word is a term of any item; the last place is for words of no item, numbered -1.
        self.term = np.zeros(self.size + 1, bool)
        self.term[np.concatenate([np.zeros(0, np.int64), *of])] = True

    def numbers(self, text: str) -> np.ndarray:
        """The number of each word of a text, -1 for words of no item."""
        words = split_words(text)
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))


class Passages:
    """All passages of some texts, given by the numbers of their words, as sparse rows: `row`, `term` and how many `times`."""

    def __init__(self, texts: pa.ListArray, is_term: np.ndarray):
        ends = texts.offsets.to_numpy().astype(np.int64)
        self.flat, self.ends = texts.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
        sizes = np.diff(self.ends)
        n = np.where(sizes > 0, np.maximum(1, 1 - (PASSAGE - sizes) // STRIDE), 0)
        self.first = np.concatenate([[0], np.cumsum(n)])
        where = np.flatnonzero(is_term[self.flat])
        text = np.searchsorted(self.ends, where, "right") - 1
        at, first, term = (where - self.ends[text]) // STRIDE, self.first[text], self.flat[where].astype(np.int64)
        # a word is in the passage of its stride and in the one before, as far as the text has them
        own, before = at < n[text], at > 0
        keys = np.concatenate([(first + at)[own] * len(is_term) + term[own], (first + at - 1)[before] * len(is_term) + term[before]])
        keys, self.times = np.unique(keys, return_counts=True)
        self.row, self.term = keys // len(is_term), keys % len(is_term)

    def text(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, rows, "right") - 1

    def words(self, rows: np.ndarray) -> np.ndarray:
        """The words of passages, -1 beyond the end of a text."""
        text = self.text(rows)
        at = (self.ends[text] + (rows - self.first[text]) * STRIDE)[:, None] + np.arange(PASSAGE)
        return np.where(at < self.ends[text + 1][:, None], self.flat[np.minimum(at, len(self.flat) - 1)], -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some `SLICE` words, or one of more; the words are the last column."""
    for b in batches:
        ends = b.columns[-1].offsets.to_numpy()
        k = 0
        while k < b.num_rows:
            n = max(1, int(np.searchsorted(ends, int(ends[k]) + SLICE, "right")) - 1 - k)
            yield b.slice(k, n)
            k += n


def _passages(bench: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of texts by number, and a last row of each task that counts the passages with each term, and all of them.

    Texts without any term are left out: their passages are empty rows, near to no item.
    """
    names = ["id", "seen", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, kind = np.zeros(bench.size, np.int64), 0, None
        for b in batches:
            kind = b.column(0).type
            words = [bench.numbers(text.as_py()) for text in b.column(1)]
            ends = np.cumsum([0, *map(len, words)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *words])))
            for part in _slices([pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "words"])]):
                found = Passages(part.column(1), bench.term)
                total += int(found.first[-1])
                seen += np.bincount(found.term, minlength=bench.size)
                rows = pa.array(np.unique(found.text(found.row)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.nulls(len(rows), pa.list_(pa.int64())), part.column(1).take(rows)], names)
        if kind is not None:
            counts = pa.array([np.append(seen, total)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), counts, pa.nulls(1, pa.list_(pa.int32()))], names)

    return run


def _weights(row: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the entries of normalised TF-IDF rows, and where each row that has any ends, after a 0."""
    weight = (1 + np.log(times)) * idf[term]
    ends = _runs(row)
    norm = np.sqrt(np.add.reduceat(weight**2, ends[:-1])) if len(row) else weight
    return weight / np.repeat(norm, np.diff(ends)), ends


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values end, after a 0."""
    return np.concatenate([np.flatnonzero(np.diff(values, prepend=-1)), [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _sums(matrix: np.ndarray, index: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of entries, the sum of the matrix' rows at `index` by weight; runs of one length are one product."""
    weight, sizes = weight.astype(matrix.dtype), np.diff(ends)
    out = np.zeros((len(sizes), matrix.shape[1]), matrix.dtype)
    order = np.argsort(sizes, kind="stable")
    same = _runs(sizes[order])
    for a, b in zip(same[:-1].tolist(), same[1:].tolist(), strict=True):
        size = int(sizes[order[a]])
        step = max(1, 512 // size)  # what is gathered at once stays in the cache
        for k in range(a, b, step):
            runs = order[k : min(k + step, b)]
            at = ends[runs][:, None] + np.arange(size)
            out[runs] = np.matmul(weight[at][:, None, :], matrix[index[at]])[:, 0]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], bench: Benchmark, idf: np.ndarray) -> Iterator[tuple]:
    """All passages with terms, some `ROWS` at a time: slice, its passages, the rows among them, terms, weights, ends of rows."""
    for part in _slices(batches):
        found = Passages(part.columns[-1], bench.term)
        weight, ends = _weights(found.row, found.term, found.times, idf)
        for k in range(0, len(ends) - 1, ROWS):
            to = ends[k : k + ROWS + 1]
            yield part, found, found.row[to[:-1]], found.term[to[0] : to[-1]], weight[to[0] : to[-1]], to - to[0]


def _summed(rows: DataFrame, run: Callable, width: int, height: int) -> np.ndarray:
    """A matrix of bounded size, summed over tasks: each gives rows by number, which are added up where they meet."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(v.as_py())
                total[i] = total[i] + v if i in total else v
        yield _matrix_batch(total)

    # as many parts as keep the cores busy, however large the table
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(run, "i int, v binary").repartition("i").mapInArrow(add, "i int, v binary").toArrow()
    out = np.zeros((height, width))
    for i, v in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        out[i] = np.frombuffer(v)
    return out


def _matrix_batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in rows.values()], pa.binary())], ["i", "v"])


def _product(bench: Benchmark, idf: np.ndarray, test: np.ndarray, inner: bool) -> Callable:
    """Over the rows A of a task: A'A x test, or test'A'A x test if `inner`; sums of a block in single precision."""
    single = test.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((test.shape[1] if inner else len(idf), test.shape[1]))
        touched = np.zeros(len(out), bool)
        for _, _, _, term, weight, ends in _blocks(batches, bench, idf):
            y = _sums(single, term, weight, ends)  # a row of A x test for each row with terms
            if inner:
                out += y.T @ y
                touched[:] = True
                continue
            order = np.argsort(term, kind="stable")
            runs = _runs(term[order])
            met = term[order][runs[:-1]]
            out[met] += _sums(y, np.repeat(np.arange(len(y)), np.diff(ends))[order], weight[order], runs)
            touched[met] = True
        yield _matrix_batch({int(i): out[i] for i in np.flatnonzero(touched)})

    return run


def _latent(rows: DataFrame, bench: Benchmark, idf: np.ndarray, total: float, item_rows: tuple) -> np.ndarray:
    """The right singular vectors of the largest singular values, by randomised subspace iteration.

    The items' own rows are part of the matrix, with as much weight together as all `total` passages, so that the space
    holds them however the passages are spread.
    """
    items = len(bench.ids)
    rank = min(items + RANK + OVERSAMPLED, len(idf))
    test = np.random.default_rng(17).standard_normal((len(idf), rank))
    row, term, weight = item_rows
    dense = np.zeros((items, len(idf)))
    dense[row, term] = weight * math.sqrt(max(1.0, total / items))
    for _ in range(1 + POWER):
        z = _summed(rows, _product(bench, idf, test, False), rank, len(idf)) + dense.T @ (dense @ test)
        test, _ = np.linalg.qr(z)
    gram = _summed(rows, _product(bench, idf, test, True), rank, rank) + (dense @ test).T @ (dense @ test)
    values, vectors = np.linalg.eigh(gram)
    return test @ vectors[:, np.argsort(values)[::-1][: items + RANK]]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of `a`."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    rest, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        hit = rest & places.get(x, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def _matches(bench: Benchmark, idf: np.ndarray, space: np.ndarray, item_rows: tuple, answers: list[set[int]]) -> Callable:
    """Of all passages: the candidates by cosine with the share their common subsequence covers and the answer terms found."""
    row, term, weight = item_rows
    latent = np.zeros((len(bench.ids), space.shape[1]))
    np.add.at(latent, row, space[term] * weight[:, None])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    single, nearest = space.astype(np.float32), latent.T.astype(np.float32)
    most = [min(len(w), PASSAGE) for w in bench.words]
    least = np.array([math.ceil(COVERED_WITH_ANSWER * n) for n in most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros((len(bench.ids), bench.size + 1), bool)
        for j, w in enumerate(bench.words):
            has[j, w] = True
        for part, found, rows, term, weight, ends in _blocks(batches, bench, idf):
            x = _sums(single, term, weight, ends)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cosine = x @ nearest
            near = np.flatnonzero(cosine >= COSINE)
            i, j = near // len(bench.ids), near % len(bench.ids)
            words = found.words(rows)
            # a common subsequence has no more words than the passage has words of the item
            out: list[tuple] = []
            enough = np.concatenate([[], *(has[j[k : k + ROWS, None], words[i[k : k + ROWS]]].sum(1) >= least[j[k : k + ROWS]] for k in range(0, len(i), ROWS))]).astype(bool)
            for p, q in zip(i[enough].tolist(), j[enough].tolist(), strict=True):
                share = lcs(bench.words[q], words[p]) / most[q]
                if share >= COVERED_WITH_ANSWER:
                    out.append((int(found.text(rows[p])), bench.ids[q], q, float(cosine[p, q]), share, sorted(answers[q].intersection(words[p].tolist()))))
            picked = pa.array([o[0] for o in out], pa.int64())
            columns = [pa.array([o[c] for o in out], kind) for c, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.float64()), (4, pa.float64()), (5, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(picked), *columns], ["id", "item_id", "item", "cosine", "share", "found"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Pairs of a document id and a benchmark item it holds, with the best `cosine` and `share` of its passages.

    Null and empty texts hold nothing; without items there are no pairs; items without words are held by nothing. Other
    columns are ignored. Items are searched for in blocks of `ITEMS`, each a pass over the documents.
    """
    found = _leaks_of_rows(docs, benchmark, id_col, text_col, item_col)
    found = found.groupBy(F.col("id.id").alias(id_col), "item_id")
    return found.agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"))


def _row_key(id_: Column, text: Column) -> Column:
    """What tells one document's row from another's, also where ids are null or shared: the id and a hash of the text."""
    return F.struct(id_.alias("id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("t"))


def _id_field(rows: DataFrame) -> T.StructField:
    """Rows that count words belong to no document."""
    return T.StructField("id", rows.schema["id"].dataType, True)


def _leaks_of_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """As :func:`leaks`, with the `_row_key` of the document as `id`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropna().orderBy("item", "text")
    rows = whole(docs, id_col, text_col).select(_row_key(F.col("id"), F.col("text")).alias("id"), "text")
    schema = T.StructType([_id_field(rows), *_HIT])
    out, block, any_left = spark.createDataFrame([], schema), [], items.toLocalIterator()
    for item in any_left:
        block.append((item["item"], item["text"]))
        if len(block) == ITEMS:
            out, block = out.unionByName(_block_leaks(spark, rows, block, schema)), []
    if block:
        out = out.unionByName(_block_leaks(spark, rows, block, schema))
    return out


_HIT = [T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType())]


def _block_leaks(spark: SparkSession, rows: DataFrame, items: list[tuple[int, str]], schema: T.StructType) -> DataFrame:
    bench = Benchmark(items)
    if not bench.size:
        return spark.createDataFrame([], schema)
    found = kept(rows.mapInArrow(_passages(bench), T.StructType([_id_field(rows), *_WORDS])))
    seen = np.zeros(bench.size + 1)
    counted = found.filter("seen IS NOT NULL").select(F.posexplode("seen").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen[counted.column(0).to_numpy()] = counted.column(1).to_numpy()  # as many rows as the benchmark has words
    idf = np.where(bench.term, np.log1p((1 + seen[-1]) / (1 + seen)), 0.0)[:-1]
    texts = found.filter("words IS NOT NULL")
    entries = [(j, *np.unique(w[bench.term[w]], return_counts=True)) for j, w in enumerate(bench.words)]
    row = np.repeat(np.arange(len(items)), [len(t) for _, t, _ in entries])
    term, times = (np.concatenate([e[c] for e in entries]) for c in (1, 2))
    item_rows = row, term, _weights(row, term, times, idf)[0]
    space = _latent(texts.select("words"), bench, idf, float(seen[-1]), item_rows)
    answers = [set(t[np.argsort(-idf[t], kind="stable")][:ANSWER_TERMS].tolist()) for t in bench.terms_of]
    sizes = {j: max(1, len(a)) for j, a in enumerate(answers)}
    hits = texts.select("id", "words").mapInArrow(_matches(bench, idf, space, item_rows, answers), T.StructType([_id_field(rows), *_CANDIDATE]))
    best = hits.groupBy("id", "item_id", "item").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    need = spark.createDataFrame([(j, n) for j, n in sizes.items()], "item int, answers int")
    best = best.join(need, "item").filter((F.col("share") >= COVERED) | (F.size("found") >= ANSWERED * F.col("answers")))
    return best.groupBy("id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share")).select("id", "item_id", "cosine", "share")


_WORDS = [T.StructField("seen", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType()))]
_CANDIDATE = [
    T.StructField("item_id", T.LongType()), T.StructField("item", T.IntegerType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("share", T.DoubleType()), T.StructField("found", T.ArrayType(T.LongType())),
]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, `contaminated`, and `item_ids`, the items it holds in order.

    A row is judged by its own text, also where its id is null or shared; repeated rows are told each.
    """
    held = _leaks_of_rows(docs, benchmark, id_col, text_col, item_col).groupBy("id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    held = kept(held.select(F.col("id").alias("held"), "item_ids"))
    rows = docs.select(docs[id_col].alias("id"), _row_key(docs[id_col], docs[text_col]).alias("key"))
    out = rows.join(held, F.col("key") == F.col("held"), "left")
    return out.select(F.col("id").alias(id_col), F.col("held").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item, with all columns as they are.

    A row is judged by its own text, also where its id is null or shared: null and empty texts stay, repeated rows stay or
    go together, an empty table stays one.
    """
    (name,) = fresh(docs, "held")
    held = kept(_leaks_of_rows(docs, benchmark, id_col, text_col, item_col).select(F.col("id").alias(name)).distinct())
    return docs.join(held, _row_key(docs[id_col], docs[text_col]) == F.col(name), "left_anti")
