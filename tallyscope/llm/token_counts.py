"""Token counts by a compiled finite-state transducer whose transitions carry the number of emitted tokens.

Merging the best pair first leaves a list of pieces exactly when it leaves each two neighbours (`Vocabulary.stable`), and
what it makes of a beginning of a text stays the same up to one last piece that depends on what follows. So reading from
left to right, the last piece at each place is the only known piece that ends there and is stable beside the last piece
of the place where it starts. A state holds what that needs: the pieces begun but not ended, each with the last piece at
its start and with the tokens counted since. Reading a character leads to one next state and adds a number of tokens,
which may be negative when a longer piece replaces several. States and transitions are made when first met and then kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import whole
from tallyscope.llm.pieces import SPACE, Kept, Vocabulary, compiled

#: Characters of a chunk; a longer text is several chunks.
CHUNK = 1 << 15
#: States that are kept; beyond that they are all forgotten and made anew.
STATES = 250_000


class Transducer:
    """Deterministic: from a state and a character to a state and a change of the token count."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

        self.known, self.words = Kept(self.run), Kept(self._word)

    def _forget(self) -> None:
        #: A state: its transitions by character; under None the pieces begun: tree, last piece before, tokens since then.
        self.start: dict = {None: ((0, "", 0),)}
        self.states = {self.start[None]: self.start}
        self.entries: dict[tuple, tuple] = {}  # each kept once

    def _made(self, state: dict, char: str) -> tuple[dict, int]:
        v, begun, last, delta = self.v, [], None, 0
        known, trees, once = v.known, v.trees, self.entries.setdefault
        for tree, before, since in state[None]:
            node = trees[tree].get(char)
            if node is None:
                continue
            piece, below, tree = node
            if below:
                begun.append((tree, before, since))
            if last is None and piece is not None:
                stable = known[before].get(piece)
                if v.stable(before, piece) if stable is None else stable:
                    last, delta = piece, since + 1
        if last is None:  # no piece ends here: the character stands for its bytes
            last, delta = char, v.cost(char)
        key = [once(e, e) for e in [(tree, before, since - delta) for tree, before, since in begun]]
        key.append(once(e := (0, last, 0), e))
        key = tuple(key)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = {None: key}
        state[char] = to, delta
        return to, delta

    def run(self, segment: str) -> int:
        """Tokens of a segment, read from the start state."""
        if len(self.states) > STATES:
            self._forget()
        state, n = self.start, 0
        for c in segment:
            step = state.get(c)
            if step is None:
                step = self._made(state, c)
            state, delta = step
            n += delta
        return n

    def _word(self, word: str) -> int:
        return sum(map(self.known.__getitem__, self.v.segments.findall(SPACE + word)))

    def state_map(self, chunk: str) -> StateMap:
        """A chunk as a map of states: what it reads before it comes to the start state, its count from there, its rest."""
        parts = self.v.segments.findall(chunk)
        if len(parts) < 2:
            return StateMap(chunk, None, "")
        return StateMap(parts[0], sum(map(self.known.__getitem__, parts[1:-1])), parts[-1])

    def closed(self, m: StateMap) -> int:
        """The count of a map put to the start state and ended."""
        return self.known[m.head] + (0 if m.count is None else m.count + self.known[m.tail])

    def composed(self, a: StateMap, b: StateMap) -> StateMap:
        """First `a`, then `b`. Associative, so neighbours may be composed in any grouping."""
        between = self.state_map((a.head if a.count is None else a.tail) + b.head)
        if a.count is None:
            if b.count is None or between.count is None:
                return StateMap(between.head, between.count if b.count is None else b.count, between.tail if b.count is None else b.tail)
            return StateMap(between.head, between.count + self.known[between.tail] + b.count, b.tail)
        if b.count is None:
            if between.count is None:
                return StateMap(a.head, a.count, between.head)
            return StateMap(a.head, a.count + self.known[between.head] + between.count, between.tail)
        return StateMap(a.head, a.count + self.closed(between) + b.count, b.tail)

    def total(self, text: str) -> int:
        """Tokens of a whole text: the maps of its chunks, composed pairwise, level by level, and put to the start state."""
        text = self.v.normalised(text)
        if len(text) <= CHUNK:
            words = self.v.words(text)
            if words is not None:
                return sum(map(self.words.__getitem__, words))
            return sum(map(self.known.__getitem__, self.v.segments.findall(text)))
        maps = [self.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.closed(maps[0])


class StateMap:
    """What a chunk does to a state. `count` is None if the start state never comes in it; then all of it is `head`."""

    __slots__ = ("count", "head", "tail")

    def __init__(self, head: str, count: int | None, tail: str):
        self.head, self.count, self.tail = head, count, tail


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more than `limit` tokens).

    `model` is the content of a model file; it is broadcast, and compiled once per Python worker. A null or empty text
    has 0 tokens. Repeated rows stay repeated, other columns are ignored, an empty table gives an empty one. Memory: the
    kept states and counts have fixed bounds, a text of any length is read once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = whole(docs, id_col, text_col).select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = compiled(Transducer, shared.value)
        for b in batches:
            n = pa.array([reader.total(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(counted, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
