"""A SentencePiece BPE model file: its pieces, its normaliser settings and the merge order between two pieces."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from sys import getsizeof

#: Fixed values of the file format: piece types, and the escape of the blank.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


Tree = dict[str, list]


class Kept(dict):
    """Results of `make` by key, to save time: the last `ROOM` bytes, and as many before, of keys that were met twice.

    A worker keeps them from task to task, and an executor may have more workers than tasks, so they must stay small. Most
    words of a corpus are met once and need no room. Results of long keys are not kept.
    """

    def __init__(self, make: Callable[[str], object]):
        self.make, self.older, self.size, self.met = make, {}, 0, bytearray(MET)

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > SHORT:
                return value
            at = hash(key) % MET
            if not self.met[at]:
                self.met[at] = 1
                return value
        size = getsizeof(key) + getsizeof(value) + SLOT
        if self.size + size > ROOM:
            self.older, self.size, self.met = dict(self), 0, bytearray(MET)
            self.clear()
        self.size += size
        self[key] = value
        return value


class Vocabulary:
    """The pieces that merges can make, by text; what a character costs that is none; and the settings."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        self.add_dummy_prefix, self.squeeze, self.escape, bytes_fall_back, charsmap = True, True, True, False, b""
        kind_of_model = 1
        for number, value in _fields(model):
            if number == 1:
                self._add(value)
            elif number == 2:
                spec = dict(_fields(value))
                kind_of_model, bytes_fall_back = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.add_dummy_prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if kind_of_model != BPE_MODEL or not bytes_fall_back or charsmap or self.squeeze or not self.escape or USER_DEFINED in self.kinds:
            raise ValueError("only BPE models with byte fallback, identity normaliser and escaped blanks are compiled")
        #: What `stable` has found so far, by the left piece.
        self.known: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_known = 0
        self.longest = max(map(len, self.ids), default=1)
        #: The tree of pieces: by character the piece that ends there, if any, the tree below, and that tree's number.
        self.root: Tree = {}
        self.trees = [self.root]
        for piece in self.ids:
            node, tree = None, self.root
            for c in piece:
                if c not in tree:
                    self.trees.append({})
                    tree[c] = [None, self.trees[-1], len(self.trees) - 1]
                node = tree[c]
                tree = node[1]
            node[0] = piece
        letters = re.escape("".join(sorted({c for piece in self.ids for c in piece if c.isalpha()}))) or "a"
        #: Blanks and letters, or blanks and other characters, up to the next blank or change.
        self.segments = re.compile(f"{SPACE}*(?:[{letters}]+|[^{letters}{SPACE}]+)|{SPACE}+")
        if not all(self.segments.fullmatch(piece) for piece in self.ids):
            raise ValueError("a piece reaches over the end of a segment")

    def _add(self, message: bytes) -> None:
        spec = dict(_fields(message))
        piece, kind, at = spec.get(1, b"").decode(), spec.get(3, NORMAL), len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)
        if kind in (NORMAL, UNUSED):
            self.ids[piece], self.scores[piece] = at, struct.unpack("<f", spec.get(2, b"\0\0\0\0"))[0]
        elif kind == BYTE:
            self.byte_ids[int(piece[3:-1], 16)] = at
        elif kind == UNKNOWN:
            self.unknown = at

    def normalised(self, text: str) -> str:
        """What the model's normaliser makes of a text: blanks escaped, one put before a text that is not empty."""
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.add_dummy_prefix else text

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, 0
            for i, pair in enumerate(map(str.__add__, parts, parts[1:])):
                found = score(pair)
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether merging leaves `left` and `right` as they are, one beside the other ('': a segment's start)."""
        if self.n_known >= PAIRS:
            self.known.clear()
            self.n_known = 0
        self.n_known += 1
        out = self.known[left][right] = self.merged(left + right) == ([left, right] if left else [right])
        return out

    def words(self, text: str) -> list[str] | None:
        """A normalised text cut before each blank, the blanks left out; None if that would hide runs of blanks."""
        return None if SPACE * 2 in text or text[:1] != SPACE else text.split(SPACE)[1:]

    def cost(self, char: str) -> int:
        """Tokens of a single character: one, or one for each byte of a character that is no piece."""
        return 1 if char in self.ids else len(char.encode())


#: Bytes of each table of results that are only kept to save time, and of an entry beside its key and value; marks of the
#: keys met once; entries of the pairs. What is forgotten is made again.
ROOM, SLOT = 16 << 20, 64
MET = 1 << 20
PAIRS = 400_000
#: Longest key of a kept result.
SHORT = 40
_compiled: dict[tuple[str, str], object] = {}


def compiled(kind: type, model: bytes):
    """One `kind(Vocabulary(model))` for each Python worker."""
    key = (kind.__name__, hashlib.sha256(model).hexdigest())
    if key not in _compiled:
        _compiled[key] = kind(Vocabulary(model))
    return _compiled[key]
