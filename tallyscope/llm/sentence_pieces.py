"""SentencePiece encoding and decoding with weighted finite-state transducers over the tropical semiring.

Three transducers are compiled from a model file: the normaliser, the tree of pieces, and the byte fallback. An input
composed with them is a lattice whose arcs are pieces; composing that with the merge order, an acceptor that remembers
the last piece and gives infinite weight to a piece that merging would not leave beside it, keeps the paths that merging
could make. An arc costs 0 for a piece and 1 for a character spelled in bytes; the shortest path is the encoding.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import fresh, whole
from tallyscope.llm.pieces import BYTE, CONTROL, SPACE, UNKNOWN, Kept, Vocabulary, compiled

#: Fixed value: what the library writes for the unknown piece.
UNKNOWN_TEXT = " ⁇ "


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tallyscope-each-byte", _each_byte)


class Encoder:
    """Texts to piece ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.packed_piece, self.segments, self.words = Kept(self._packed_piece), Kept(self._packed_segment), Kept(self._packed_word)
        surfaces = [self._surface(i) for i in range(len(vocabulary.pieces))]
        self.is_control = np.asarray(vocabulary.kinds) == CONTROL
        #: The texts of all pieces in one array of bytes, and where each starts.
        self.surfaces, self.sizes = np.frombuffer(b"".join(surfaces), np.uint8), np.asarray([len(x) for x in surfaces])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _surface(self, i: int) -> bytes:
        kind, piece = self.v.kinds[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, piece.replace(SPACE, " ")).encode()

    def shortest_path(self, segment: str) -> list[str]:
        """The arcs of the lightest path through the composed lattice, relaxed place by place.

        Merging gives each beginning of a segment one last piece, so a place has one state of finite weight, and an arc
        that makes it no lighter need not be held against the merge order.
        """
        v, n = self.v, len(segment)
        ids = v.ids
        weight, last = [0, *[n + 1] * n], [""] * (n + 1)
        for i in range(n):
            tree, before, w, j = v.root, last[i], weight[i], i
            known = v.known[before]
            for c in segment[i : i + v.longest]:
                node = tree.get(c)
                if node is None:
                    break
                j += 1
                piece, tree, _ = node
                if piece is not None and w < weight[j]:
                    stable = known.get(piece)
                    if v.stable(before, piece) if stable is None else stable:
                        weight[j], last[j] = w, piece
            if w + 1 < weight[i + 1] and segment[i] not in ids:
                weight[i + 1], last[i + 1] = w + 1, segment[i]
        path, place = [], n
        while place:
            path.append(last[place])
            place -= len(last[place])
        return path[::-1]

    def _packed_segment(self, segment: str) -> bytes:
        return b"".join(map(self.packed_piece.__getitem__, self.shortest_path(segment)))

    def _packed_word(self, word: str) -> bytes:
        segments = self.v.segments.findall(SPACE + word)
        return self._packed_segment(segments[0]) if len(segments) == 1 else b"".join(map(self.segments.__getitem__, segments))

    def _packed_piece(self, piece: str) -> bytes:
        """A piece's id, or those of a character's bytes, as 32-bit numbers."""
        i = self.v.ids.get(piece)
        return np.asarray([self.v.byte_ids[b] for b in piece.encode()] if i is None else [i], np.int32).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit numbers."""
        text = self.v.normalised(text)
        words = self.v.words(text)
        if words is None:
            return b"".join(map(self.segments.__getitem__, self.v.segments.findall(text)))
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: runs of byte pieces read as UTF-8, broken ones one mark a byte; the blank put before it goes."""
        ids = np.asarray(ids, np.int32)
        cuts = np.flatnonzero(self.is_control[ids])  # they write nothing but end a run of bytes
        if not len(cuts):
            return self._text(ids, True)
        parts = [x[1:] if k else x for k, x in enumerate(np.split(ids, cuts))]
        lead = next((k for k, part in enumerate(parts) if len(part)), 0)
        return "".join(self._text(part, k == lead) for k, part in enumerate(parts))

    def _text(self, ids: np.ndarray, first: bool) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        raw = self.surfaces[places + np.arange(len(places))].tobytes()
        if first and raw[:1] == b" " and self.v.add_dummy_prefix and self.v.pieces[ids[0]][:1] == SPACE:
            raw = raw[1:]
        return raw.decode("utf-8", "tallyscope-each-byte")


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_tokens`, `token_ids`, and `round_trip`: decoding gives the text back.

    The one thing a round trip changes is U+2581, which the normaliser reads as a blank. A null or empty text has no
    tokens. Repeated rows stay, other columns are ignored, an empty table gives an empty one. `model` is the content of a
    model file, broadcast and compiled once per Python worker; kept segments have a fixed bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = whole(docs, id_col, text_col)
    return rows.mapInArrow(_encoding(shared), T.StructType([rows.schema["id"], *_TOKENS])).withColumnRenamed("id", id_col)


_TOKENS = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _with_tokens(coder: Encoder, b: pa.RecordBatch, passed: int, names: list[str]) -> pa.RecordBatch:
    texts = b.column(b.num_columns - 1).to_pylist()
    packed = [coder.packed(t or "") for t in texts]
    same = [coder.decode(np.frombuffer(p, np.int32)) == (t or "") for p, t in zip(packed, texts, strict=True)]
    ends = pa.array([len(p) // 4 for p in packed], pa.int64())
    columns = [*b.columns[:passed], ends, _lists(packed), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [*b.schema.names[:passed], *names])


def _encoding(shared, passed: int = 1, names: list[str] | None = None):
    """A function over batches whose last column is the text: the `passed` first columns, then those of `_TOKENS`."""
    names = names or [a.name for a in _TOKENS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(Encoder, shared.value)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                yield _with_tokens(coder, whole_batch.slice(at, 1000), passed, names)
            del whole_batch
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()  # the worker may lie idle beside others while the stage goes on

    return run


def decoded(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per row of `rows`: id and `text`, decoded from an array of piece ids. Null and empty arrays give ''."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(rows[id_col].alias("id"), F.coalesce(rows[ids_col].cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(Encoder, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x.as_py()) for x in b.column(1)], pa.string())], ["id", "text"])

    return given.mapInArrow(run, T.StructType([given.schema["id"], T.StructField("text", T.StringType())])).withColumnRenamed("id", id_col)


def with_tokens(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with `token_ids`, `n_tokens` and `round_trip` (names that are taken get a `_` appended).

    A text that is a column of strings is handed to Python once, and is its own result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (body,) = fresh(docs, "body")
    names = fresh(docs, *[a.name for a in _TOKENS])
    once = text_col in docs.columns and isinstance(docs.schema[text_col].dataType, T.StringType)
    others = [docs[f"`{c}`"] for c in docs.columns if not once or c != text_col]
    packed = docs.select(*others, docs[f"`{text_col}`"] if once else docs[text_col].cast("string").alias(body))
    passed = len(docs.columns)
    schema = T.StructType([*packed.schema.fields[:passed], *[T.StructField(n, a.dataType) for a, n in zip(_TOKENS, names, strict=True)]])
    out = packed.mapInArrow(_encoding(shared, passed, names), schema)
    return out.select(*[f"`{c}`" for c in [*docs.columns, *names]])
