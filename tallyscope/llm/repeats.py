"""Repeated passages: difference-cover suffix arrays over the surroundings of content-defined anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import whole
from tallyscope.llm.shingles import MIX, mixed

#: Bytes of a string that may not come twice, and of the anchors inside it.
WINDOW, GRAM = 100, 20
#: Starts looked at together in one text; bytes sorted together in a task.
STEP, CHUNK = 1 << 20, 1 << 16
#: Bits for a place among the grams looked at together.
_PLACE = np.uint64((1 << 21) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the `GRAM` bytes from each place."""

    def joined(x: np.ndarray, k: int, y: np.ndarray, m: int) -> np.ndarray:
        size = min(len(x), len(y) - k)
        return x[:size] * np.uint64(pow(int(MIX[4]), m, 1 << 64)) + y[k : k + size]

    power, size = mixed(data.astype(np.uint64) + MIX[1]), 1
    out, have = None, 0
    while True:
        if GRAM & size:
            out, have = (power, size) if out is None else (joined(power, size, out, have), have + size)
        if 2 * size > GRAM:
            return mixed(out)
        power, size = joined(power, size, power, size), 2 * size


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows of `data`, cut into runs with a common anchor: first start, number of starts, hash.

    A window's anchor is the last of its grams with the smallest hash (by all but its 21 lowest bits), so equal windows have it at the same place.
    """
    lows, sizes, hashes = [], [], []
    for at in range(0, len(data) - WINDOW + 1, STEP):
        g = _grams(np.frombuffer(data, np.uint8, min(STEP + WINDOW - 1, len(data) - at), at))
        # the hash's upper bits and, below them, the place from the end: one minimum finds both
        best, wide, k = (g & ~_PLACE) | (_PLACE - np.arange(len(g), dtype=np.uint64)), WINDOW - GRAM + 1, 1
        while k < wide:
            step = min(k, wide - k)
            best = np.minimum(best[: len(best) - step], best[step:])
            k += step
        best = (_PLACE - (best & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        lows.append(first + at)
        sizes.append(np.diff(np.append(first, len(best))))
        hashes.append(g[best[first]].view(np.int64))
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(lows), np.concatenate(sizes), np.concatenate(hashes)


def _surroundings(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, a hash of all bytes that their windows cover, and whether the same was met before in `data`."""
    low, size, gram = anchors(data)
    text = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + n + WINDOW - 1]) for a, n in zip(low.tolist(), size.tolist(), strict=True)), np.uint64, len(low)).view(np.int64)
    order = np.lexsort((text, gram))  # keeps the order of what is equal
    again = np.zeros(len(low), bool)
    again[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return low, size, gram, text, again


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of positive numbers by the difference cover 1, 2 modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    pad = np.concatenate([s, np.zeros(3, np.int64)]).astype(np.int64)
    # one place beyond the end if n % 3 = 1, so that the two halves below stay apart
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    base = int(pad.max()) + 1
    twos = pad[:-1] * base + pad[1:]
    if base >= 1 << 21 or n >= 1 << 21:  # three numbers, or two and a rank, are to fit into 63 bits
        twos = np.unique(twos, return_inverse=True)[1]
    triples = twos[sampled] * base + pad[np.minimum(sampled + 2, n + 2)]
    order = np.argsort(triples)
    ordered = triples[order]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if names.max() < len(order):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    cover = sampled[order]
    cover = cover[cover < n]
    # the remaining suffixes, by their first number and the rank of what follows
    size = len(order) + 2
    pairs = pad[:-1] * size + rank[1:]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(pairs[rest])]
    # merge: the number of sampled suffixes before each remaining one, apart for those after which one or two places are sampled
    one, two = cover[cover % 3 == 1], cover[cover % 3 == 2]
    places = np.searchsorted(pairs[one], pairs[rest])
    places += np.searchsorted(twos[two] * size + rank[two + 2], twos[rest] * size + rank[rest + 2])
    out = np.empty(n, np.int64)
    places += np.arange(len(rest))
    others = np.ones(n, bool)
    others[places] = False
    out[places], out[others] = rest, cover
    return out


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """For strings in order of their places: which windows of each are also in an earlier place."""
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings])
    starts = np.concatenate([[0], ends[:-1]])
    order = suffix_array(data.astype(np.int64) + 1)
    room = np.repeat(ends - 1, ends - starts)
    order = order[order + WINDOW <= room[order]]
    same = np.zeros(len(order), bool)
    for k in range(1, len(order), STEP >> 4):
        a, b = order[k - 1 : k - 1 + (STEP >> 4)], order[k : k + (STEP >> 4)]
        a = a[: len(b)]
        near = np.ones(len(b), bool)
        for j in range(WINDOW):
            near[near] = data[a[near] + j] == data[b[near] + j]
        same[k : k + len(b)] = near
    again = np.zeros(len(data), bool)
    if len(order):
        heads = np.flatnonzero(~same)
        first = np.minimum.reduceat(order, heads)
        again[order] = order > np.repeat(first, np.diff(np.append(heads, len(order))))
    return [again[a : max(a, b - WINDOW)] for a, b in zip(starts, ends, strict=True)]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per anchor. Those that come again in their text are joined to runs of windows, with `low` as -1 - start."""
    for b in batches:
        rows, found = [], [[np.zeros(0, np.int64)] * 4]
        for i, (id_, text) in enumerate(zip(b.column(0), b.column(2), strict=True)):
            low, size, gram, said, again = _surroundings(text.as_py().encode("utf-8", "surrogatepass"))
            found.append([gram[~again], said[~again], low[~again], size[~again]])
            if again.any():
                runs = runs_of(np.repeat(again, size), 0)
                starts = np.array([r["start"] for r in runs], np.int64)
                sizes = np.array([r["end"] for r in runs], np.int64) - starts - (WINDOW - 1)
                # no anchor's hash, but one of the document, so that these rows are spread
                spread = np.full(len(runs), xxhash.xxh3_64_intdigest(repr(id_.as_py())), np.uint64).view(np.int64)
                found.append([spread, spread, -1 - starts, sizes])
                rows.append(np.full(len(low) - again.sum() + len(runs), i))
            else:
                rows.append(np.full(len(low), i))
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], ["id", "t", "gram", "said", "low", "size"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, surroundings and place: those whose hash has come at two places.

    The first with some surroundings is to be compared, if others have the same hash; all after it are copies.
    Runs within a text are copies already and pass.
    """
    names = ["id", "t", "low", "gram", "size", "compare"]
    last = first = alone = None  # hash and surroundings, the place of their first row, and that row if its hash has no other yet
    for b in batches:
        b = pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 4, 2, 5, 3)], [*names[:5], "said"])
        low = b.column(2).to_numpy()
        if (low < 0).any():
            runs = b.filter(pa.array(low < 0))
            columns = [runs.column(0), runs.column(1), pa.array(-1 - runs.column(2).to_numpy()), runs.column(3), runs.column(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(runs.num_rows, bool))], names)
            b = b.filter(pa.array(low >= 0))
        n = b.num_rows
        if not n:
            continue
        gram, said = b.column(3).to_numpy(), b.column(5).to_numpy()
        other = np.concatenate([[last is None or last[0] != gram[0]], gram[1:] != gram[:-1]])
        fresh = other | np.concatenate([[last is None or last[1] != said[0]], said[1:] != said[:-1]])
        heads = np.flatnonzero(fresh)
        if alone is not None and len(heads):
            if not other[heads[0]]:
                yield alone
            alone = None
        # the first rows: compared where their hash has other surroundings before or after them
        compare = np.zeros(n, bool)
        compare[heads] = ~other[heads]
        compare[heads[:-1]] |= ~other[heads[1:]]
        copies = ~fresh & ~_same_place(b, fresh)
        if first is not None:
            for i in range(heads[0] if len(heads) else n):
                if tuple(b.column(k)[i].as_py() for k in range(3)) != first:
                    break
                copies[i] = False  # one more row of the same document
        at = np.flatnonzero(compare | copies)
        if len(at):
            taken = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array(compare[at])], names)
        if len(heads):
            k = int(heads[-1])
            first = tuple(b.column(c)[k].as_py() for c in range(3))
            if other[k]:
                alone = pa.RecordBatch.from_arrays([*b.take(pa.array([k])).columns[:5], pa.array([True])], names)
        last = gram[-1], said[-1]


def _same_place(b: pa.RecordBatch, fresh: np.ndarray) -> np.ndarray:
    """Which rows have the place of the one that their group of rows begins with; those of a group begun earlier have not."""
    n = b.num_rows
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
    begun, head = head >= 0, np.maximum(head, 0)
    low, t = b.column(2).to_numpy(), b.column(1).to_numpy()
    same = begun & ~fresh & (low == low[head]) & (t == t[head])
    near = np.flatnonzero(same)
    mine, its = (b.column(0).take(pa.array(x)).to_pylist() for x in (near, head[near]))
    same[near] = [x == y for x, y in zip(mine, its, strict=True)]
    return same


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names)


def runs_of(again: np.ndarray, at: int) -> list[dict[str, int]]:
    """The bytes of runs of windows, the first of which starts at `at`."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    return [{"start": at + int(a), "end": at + int(b) + WINDOW - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts and their anchors met elsewhere: a row with the bytes of copied windows, and one for each surroundings to compare.

    The former needs no comparison; it has the hash of some anchor of the text, so that such rows are spread.
    """
    names = ["gram", "id", "t", "low", "said", "runs"]
    for b in batches:
        out = []
        lists = b.column(3)
        parts = [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        for i, t, text, a, z in zip(*(b.column(k).to_pylist() for k in range(3)), *(lists.offsets.to_numpy()[x].tolist() for x in (slice(-1), slice(1, None))), strict=True):
            low, gram, size, compare = (x[a:z] for x in parts)
            if not compare.all():
                runs = merged([{"start": s, "end": s + n + WINDOW - 1} for s, n in zip(low[~compare].tolist(), size[~compare].tolist(), strict=True)])
                out.append((int(gram[~compare][0]), i, t, -1, None, runs))
            if compare.any():
                data = text.encode("utf-8", "surrogatepass")
                out.extend((g, i, t, s, data[s : s + n + WINDOW - 1], None) for s, g, n in zip(low[compare].tolist(), gram[compare].tolist(), size[compare].tolist(), strict=True))
        yield _batch(out, [pa.int64(), b.column(0).type, pa.int64(), pa.int64(), pa.binary(), _RUNS_ARROW], names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of surroundings sorted by hash and place: the bytes of windows that are also at an earlier place.

    Equal windows have the same hash, so only what shares one is sorted together; small groups go into one suffix array.
    Rows that have their runs already pass.
    """
    held: list[tuple] = []
    size, id_type = 0, None

    def done() -> pa.RecordBatch:
        found = repeated_windows([x[4] for x in held])
        return given([(i, t, runs) for (_, i, t, low, *_), again in zip(held, found, strict=True) if (runs := runs_of(again, low))])

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return _batch(rows, [id_type, pa.int64(), _RUNS_ARROW], ["id", "t", "runs"])

    for b in batches:
        id_type = b.column(1).type
        yield given([(i, t, runs) for i, t, runs in zip(*(b.column(k).to_pylist() for k in (1, 2, 5)), strict=True) if runs])
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[4] is None:
                continue
            if held and x[:4] == held[-1][:4]:  # one more row of the same document
                continue
            if size >= CHUNK and x[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(x)
            size += len(x[4])
    if held:
        yield done()


def merged(runs: list[dict[str, int]]) -> list[dict[str, int]]:
    """Runs in order, those that touch or overlap as one."""
    out: list[dict[str, int]] = []
    for r in sorted(runs, key=lambda r: (r["start"], r["end"])):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, _, text, copy, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs = merged([r for part in found or [] for r in part])
            if copy > 1 and len(data) >= WINDOW:
                runs = [{"start": 0, "end": len(data)}]
            ends = [0, *(r["end"] for r in runs)]
            starts = [*(r["start"] for r in runs), len(data)]
            out.append((i, len(data), runs, b"".join(data[a:z] for a, z in zip(ends, starts, strict=True))))
        yield _batch(out, [b.column(0).type, pa.int64(), _RUNS_ARROW, pa.binary()], ["id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, `n_bytes`, `spans` (removed bytes, start and end) and `kept` (the other bytes, joined).

    A byte is removed if a string of `WINDOW` bytes over it also starts earlier: in a document of smaller id, or before
    it in the same one. Texts are taken as UTF-8 bytes, null as empty; all strings are judged on the input. Null ids come
    after all others, documents with one id in the order of a hash of their texts, and of rows equal in id and text one is
    the earlier. Shorter texts lose nothing; an empty table gives an empty one; other columns are ignored.

    Windows are dealt out by a content-defined anchor. Anchors with the same surroundings are copies of the earliest;
    different surroundings of one anchor are put into a difference-cover suffix array by the task that has the anchor,
    whose neighbours are compared byte by byte. Texts and anchors (one for some 35 bytes) are shuffled once.
    """
    rows = whole(docs, id_col, text_col)
    # a hash of the text tells documents with one id apart; where each has its own, neither that nor a null-safe join is needed
    unique = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").isEmpty()
    rows = rows.select("id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("t"), "text")
    id_field = rows.schema["id"]
    long = T.LongType()
    place = [id_field, T.StructField("t", long)]
    sort = [F.col("id").asc_nulls_last(), "t", "low"]

    found = rows.mapInArrow(_marked, T.StructType([*place, *[T.StructField(c, long) for c in ("gram", "said", "low", "size")]]))
    met = found.repartition("gram").sortWithinPartitions("gram", "said", *sort)
    met = met.mapInArrow(_met, T.StructType([*place, *[T.StructField(c, long) for c in ("low", "gram", "size")], T.StructField("compare", T.BooleanType())]))
    met = met.groupBy(F.col("id").alias("id_"), F.col("t").alias("t_")).agg(F.collect_list(F.struct("low", "gram", "size", "compare")).alias("met"))
    same = F.col("id") == F.col("id_") if unique else F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))

    # one plan from here on, in which both joins read the same shuffled texts
    looked = rows.join(met, same, "left").select("id", "t", "text", "met")
    runs_field = T.StructField("runs", _RUNS)
    looked = looked.mapInArrow(_looked_up, T.StructType([T.StructField("gram", long), *place, T.StructField("low", long), T.StructField("said", T.BinaryType()), runs_field]))
    runs = looked.repartition("gram").sortWithinPartitions("gram", *sort).mapInArrow(_compared, T.StructType([*place, runs_field]))
    runs = runs.groupBy(F.col("id").alias("id_"), F.col("t").alias("t_")).agg(F.collect_list("runs").alias("found"))

    number = F.lit(1) if unique else F.row_number().over(Window.partitionBy("id", "t").orderBy("t"))
    numbered = rows.join(runs, same, "left").withColumn("copy", number)
    cut = numbered.select("id", "t", "text", "copy", "found").mapInArrow(_cut, T.StructType([id_field, T.StructField("n_bytes", long), T.StructField("spans", _RUNS), T.StructField("kept", T.BinaryType())]))
    return cut.withColumnRenamed("id", id_col)
