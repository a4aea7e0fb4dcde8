"""Near duplicates by MinHash: one permutation, optimal densification, banded buckets and star-shaped candidates.

One hash of each shingle gives both its bin and its rank; a bin keeps its lowest, an empty bin borrows from the first
filled one in an order that is the same for all texts. Bands of bins are buckets. Texts with equal shingle sets are one
node. In each bucket only the links to its hub, the member with the smallest id (null last), are held against the full sets, so the
number of candidates grows with the members and not with their square. Members of a star that the confirmed links leave
apart may still be linked with each other: such pairs are held against the full sets too, unless the sizes, what both
share with the hub and the shingles that nobody else has prove that they share too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import fresh, kept
from tallyscope.llm.components import components
from tallyscope.llm.shingles import MIX, common, mixed, shingle_set

#: 32 bands of 4 bins: of pairs with similarity 0.75, 5 in a million share no band.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Linked: SHARE percent of the union are shared.
SHARE = 75
#: Up to so many keys are broadcast to pick the texts that are compared; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _probes() -> np.ndarray:
    """For each bin the bins it borrows from, one row for each attempt: independent hashes of bin and attempt."""
    bins, tries = np.arange(BINS, dtype=np.uint64), np.arange(1, 64 * BINS // 8, dtype=np.uint64)
    return (mixed(mixed(bins[None, :] * MIX[1] + MIX[2]) + tries[:, None] * MIX[4]) >> np.uint64(57)).astype(np.int64) % BINS


PROBES = _probes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest hash of each bin of a sorted set that is not empty, empty bins densified."""
    bins = (shingles >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled, out = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[first]] = True
    out[bins[first]] = shingles[first]
    empty, lent = np.flatnonzero(~filled), out.copy()
    for probe in PROBES:
        if not len(empty):
            break
        source = probe[empty]
        hit = filled[source]
        lent[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    if len(empty):
        lent[empty] = shingles[0]
    return lent


def bucket_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band."""
    rows = signature(shingles).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[1]
    for k in range(ROWS):
        key = key * MIX[4] + rows[:, k]
    return mixed(key).view(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    """What equal sets have in common: 128 bits."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        keys = [bucket_keys(x) if len(x) else np.zeros(0, np.int64) for x in sets]
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) for x in sets], pa.binary()), lists],
            ["id", "row", "size", "node", "keys"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of texts with the nodes they are to have: the pair, sizes and how many shingles they share."""
    last: tuple[bytes, str, np.ndarray] | None = None
    for b in batches:
        out: list[tuple] = []
        a_nodes, b_nodes = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k in range(b.num_rows):
            at = b.column(2)[k].as_py()
            if last is None or last[0] != a_nodes[k] or last[1] != at:
                last = (a_nodes[k], at, shingle_set(at))
            x, y = last[2], shingle_set(b.column(3)[k].as_py())
            if node_of(x) == a_nodes[k] and node_of(y) == b_nodes[k]:  # else two rows with one key
                out.append((a_nodes[k], b_nodes[k], len(x), len(y), common(x, y)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, _PAIR_TYPES, strict=True)], _PAIR)


_PAIR = ["a", "b", "size_a", "size_b", "both"]
_PAIR_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_PAIR_SCHEMA = "a binary, b binary, size_a long, size_b long, both long"


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of nodes with their sizes and shared shingles, counted on the full sets."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_shared, _PAIR_SCHEMA).distinct()


def _linked(both: Column, size_a: Column, size_b: Column) -> Column:
    return (100 + SHARE) * both >= SHARE * (size_a + size_b)


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, text in zip(b.column(0), b.column(1), strict=True):
            x = shingle_set(text.as_py())
            if node_of(x) == node.as_py():
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(x), pa.binary()), pa.array(x.view(np.int64))], ["node", "shingle"])


def _rest(stars: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a star's members that the links so far leave apart and that no bound rules out. `stars`: see `_compared`."""
    label = labels.select(F.col("node").alias("n_"), F.col("comp").alias("c_"))
    stars = stars.join(label, F.col("a") == F.col("n_"), "left").select(*_PAIR, F.coalesce("c_", "a").alias("comp_a"))
    stars = kept(stars.join(label, F.col("b") == F.col("n_"), "left").select(*_PAIR, "comp_a", F.coalesce("c_", "b").alias("comp")))
    apart = kept(stars.filter("comp <> comp_a").select("a").distinct())
    stars = kept(stars.join(apart, "a", "left_semi"))
    nodes = kept(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # shingles that only one of all these nodes has cannot be shared
    single = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(_unique, "node binary, shingle long")
    single = single.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    single = single.groupBy("node").agg(F.count("*").alias("single"))
    # beyond what is shared with the hub, a pair shares at most what either has beside that and not alone
    m = stars.join(single.withColumnRenamed("node", "n_"), F.col("b") == F.col("n_"), "left")
    m = kept(m.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("size_b").alias("size"), "both", "comp", (F.col("comp") != F.col("comp_a")).alias("out"), (F.col("size_b") - F.coalesce("single", F.lit(0)) - F.col("both")).alias("more")))
    x, y = m.filter("out").alias("x"), m.alias("y")
    bound = F.least("x.both", "y.both") + F.least("x.more", "y.more")
    test = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.out") | (F.col("x.node") < F.col("y.node")))
    return x.join(y, test & _linked(bound, F.col("x.size"), F.col("y.size"))).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _row_key(id_: Column, text: Column) -> Column:
    """128 bits that only rows with equal id and text have in common; a null id is one of its own."""
    name = id_.cast("string")
    said = F.when(id_.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(name).cast("string"), F.lit(":"), name))
    return F.unhex(F.md5(F.concat(said, F.lit(" "), text)))


def _lowest(*columns: str) -> Column:
    """What belongs to the smallest id, null ids last."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", *columns))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `id`, `text` and `row`, the key of both: a row per document with its size and node, and a row per node with its component.

    A component has the `comp` id, its smallest, and the node `head` that holds this id.
    """
    marks = kept(docs.mapInArrow(_fingerprints, T.StructType([docs.schema["id"], *_MARKS])))
    nodes = marks.groupBy("node").agg(_lowest("row").alias("low"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = kept(nodes.select("node", F.col("low.id").alias("id"), F.col("low.row").alias("row"), "size", "keys"))
    slots = nodes.filter("size > 0").select("node", "id", F.explode("keys").alias("key"))
    hubs = kept(slots.groupBy("key").agg(_lowest("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("hub.node").alias("a")))
    stars = kept(slots.join(hubs, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    used = kept(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row"), "node"))
    n_used = used.count()
    few = F.broadcast(used) if n_used <= BROADCAST_IDS else used
    texts = kept(docs.join(few, "row").select("node", "text"))
    if texts.count() > n_used:  # rows that are equal in id and text
        texts = kept(texts.distinct())
    stars = kept(_compared(stars, texts))
    links = stars.filter(_linked(F.col("both"), F.col("size_a"), F.col("size_b"))).select("a", "b")
    labels = components(links)
    more = kept(_compared(_rest(stars, labels, texts), texts)).filter(_linked(F.col("both"), F.col("size_a"), F.col("size_b")))
    if not more.isEmpty():
        labels = components(links.unionByName(more.select("a", "b")))
    joined = nodes.select("node", "id").join(labels.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").select("node", "id", F.coalesce("comp", "node").alias("group"))
    first = joined.groupBy("group").agg(_lowest("node").alias("low"))
    first = kept(first.select("group", F.col("low.id").alias("comp"), F.col("low.node").alias("head")))
    return marks.select("id", "row", "size", "node"), kept(joined.join(first, "group").select("node", "comp", "head"))


_MARKS = [T.StructField("row", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: `id`, `row`, `size`, `node`, the component's id `own` and whether it is `kept`."""
    text = F.coalesce(docs[text_col], F.lit(""))
    marks, classes = _classes(docs.select(docs[id_col].alias("id"), text.alias("text"), _row_key(docs[id_col], text).alias("row")))
    out = marks.join(classes.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"))
    alone = F.col("size") == 0
    own = F.when(alone, F.col("id")).otherwise(F.col("comp"))
    is_kept = alone | (F.col("id").eqNullSafe(F.col("comp")) & (F.col("node") == F.col("head")))
    return out.select("id", "row", "size", "node", own.alias("own"), is_kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_shingles`, `component_id` (the smallest id it is linked with) and `kept` (it is that one).

    Null and empty texts have no shingles and are linked with nothing, so they are kept. Repeated rows are copies of each
    other and all carry the kept id. Rows that share an id but not the text are told apart by their shingles; if they are
    linked, the text of one is kept. A null id is the largest: a component without any other has a null `component_id`.
    Other columns are ignored, an empty table gives an empty one.
    """
    out = _judged(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("own").alias("component_id"), "kept")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all columns as they are; of its copies under this id, one.

    Ids may be null or shared by several texts. Texts without shingles are kept, one for each id that is not null.
    """
    found = _judged(docs, id_col, text_col).filter("kept")
    # one text for each id and set of shingles; what has neither is no copy of anything
    found = found.groupBy("id", "node").agg(F.min("row").alias("kept__row"), F.first("size").alias("kept__size"))
    found = found.select("kept__row", (F.col("id").isNull() & (F.col("kept__size") == 0)).alias("kept__all"))
    row, each, one = fresh(docs, "row__", "each__", "one__")
    rows = docs.withColumn(row, _row_key(docs[id_col], F.coalesce(docs[text_col], F.lit(""))))
    same = found.withColumnsRenamed({"kept__row": one, "kept__all": each})
    rows = rows.join(same, F.col(row) == F.col(one))
    rows = rows.withColumn(each, F.when(F.col(each), F.monotonically_increasing_id()))
    return rows.dropDuplicates([row, each]).select(*[F.col(f"`{c}`") for c in docs.columns])
