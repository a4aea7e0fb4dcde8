"""Removal of repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyscope.llm import repeats
from tallyscope.llm.repeats import WINDOW, anchors, repeated_windows, suffix_array, without_repeats

SCHEMA = "doc_id long, text string, low int, t string, spans int"


def brute(docs):
    """Rows in the order of their places: spans and kept bytes."""
    seen, out = set(), []
    for text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        new = set()
        for i in range(len(data) - WINDOW + 1):
            s = data[i : i + WINDOW]
            if s in seen or s in new:
                gone[i : i + WINDOW] = True
            new.add(s)
        seen |= new
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def found_by(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(parts)
    return [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in without_repeats(df).collect()]


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randint(0, len(text))
        text = text[:at] + rng.choice(["", "x", "é", "new words"]) + text[at + rng.randint(0, 3) :]
    return text


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "ré", "passage", "日本", "a", "zz"]
    long = lambda n: " ".join(rng.choices(words, k=n))
    base = [long(rng.randint(0, 120)) for _ in range(12)]
    docs = list(base) + [edited(rng, rng.choice(base), rng.randint(0, 6)) for _ in range(25)]
    shared = long(40)
    docs += [long(10) + shared + long(5) for _ in range(8)] + ["a" * 350, "b" + "a" * 260, "ab" * 200, "abc" * 90 + shared, "", "short"]
    docs += [shared[:99], shared[:100], shared[1:101], base[0] + "\0" + base[1], "\0" * 230]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_array_is_the_sorted_order(seed):
    rng = random.Random(seed)
    for n in [*range(0, 30), 200, 1000]:
        for letters in (1, 2, 5, 300, 1 << 22):
            s = [rng.randint(1, letters) for _ in range(n)]
            assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_windows_of_strings_against_brute_force(monkeypatch):
    for seed in range(5):
        docs = [d.encode() for d in corpus(seed)]
        seen = set()
        for data, again in zip(docs, repeated_windows(docs), strict=True):
            want = []
            for i in range(max(0, len(data) - WINDOW + 1)):
                want.append(data[i : i + WINDOW] in seen)
                seen.add(data[i : i + WINDOW])
            assert again.tolist() == want


def test_anchors_cover_all_windows_in_steps_of_any_size(monkeypatch):
    data = corpus(4)[0].encode() * 3 + b"a" * 400
    for step in (repeats.STEP, 130):
        monkeypatch.setattr(repeats, "STEP", step)
        low, size, _ = anchors(data)
        assert low[0] == 0 and (low[1:] == low[:-1] + size[:-1]).all() and low[-1] + size[-1] == len(data) - WINDOW + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_is_that_of_brute_force(spark, monkeypatch, seed):
    docs = corpus(seed)
    want = [(i, len(t.encode()), *w) for i, (t, w) in enumerate(zip(docs, brute(docs), strict=True))]
    rows = list(enumerate(docs))
    assert sorted(found_by(spark, rows)) == want
    monkeypatch.setattr(repeats, "CHUNK", 300)
    assert sorted(found_by(spark, rows[::-1], 7)) == want


def test_nulls_repeated_rows_shared_ids_and_empty_tables(spark):
    a, b = "one long passage of words " * 8, "a second passage that is not the first one " * 6
    rows = [(7, None), (7, a), (7, a), (7, b), (None, a), (None, None), (3, b + "end"), (None, "x" * 99)]
    found = found_by(spark, rows)
    assert len(found) == len(rows)
    left = {}
    for i, _, _, kept in found:
        left.setdefault(i, []).append(kept)
    # of the two equal rows one keeps what no earlier place has, the other nothing
    (first_a,) = [k for _, k in brute([a])]
    assert sorted(left[7]) == sorted([b"", b"", first_a, brute([b + "end", b])[1][1]])
    assert sorted(left[None]) == sorted([b"", b"", b"x" * 99]) and left[3] == [brute([b + "end"])[0][1]]
    assert found_by(spark, []) == []


def test_met_anchors_do_not_depend_on_batches(spark):
    """Against a plain loop over the rows, with groups that go on over any border of batches."""
    import pyarrow as pa

    random.seed(5)
    rows = [(random.choice([1, 1, 1, 2, 3]), random.choice([1, 1, 2]), random.choice([None, *range(4)]), 0, random.randrange(3)) for _ in range(300)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[4]))
    expected = set()
    for g, x, i, t, low in rows:
        first = next(r for r in rows if r[:2] == (g, x))
        if (i, t, low) != first[2:]:
            expected.add((i, t, low, g, 120, False))
        elif len({r[1] for r in rows if r[0] == g}) > 1:
            expected.add((i, t, low, g, 120, True))
    rows.append((9, 9, 7, 0, -1 - 33))  # a run found within its text passes
    expected.add((7, 0, 33, 9, 120, False))

    def batch(part):
        g, x, i, t, low = (list(c) for c in zip(*part, strict=True))
        return pa.record_batch([pa.array(c, pa.int64()) for c in (i, t, g, x, low, [120] * len(g))], ["id", "t", "gram", "said", "low", "size"])

    for size in (1, 2, 7, 1000):
        met = list(repeats._met(batch(rows[k : k + size]) for k in range(0, len(rows), size)))
        assert {tuple(r.values()) for b in met for r in b.to_pylist()} == expected


def test_surroundings_are_hashed_once_per_text(spark, monkeypatch):
    """The look-up of met anchors cuts their bytes out and finds no anchors again."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "_surroundings", None)
    met = [[{"low": 5, "gram": 1, "size": 3, "compare": True}, {"low": 0, "gram": 2, "size": 4, "compare": False}], None]
    kind = pa.list_(pa.struct([("low", pa.int64()), ("gram", pa.int64()), ("size", pa.int64()), ("compare", pa.bool_())]))
    text = "".join(map(str, range(200)))
    b = pa.record_batch([pa.array([1, 2]), pa.array([0, 0]), pa.array([text, text]), pa.array(met, kind)], ["id", "t", "text", "met"])
    out = [tuple(r.values()) for x in repeats._looked_up([b]) for r in x.to_pylist()]
    assert out == [(2, 1, 0, -1, None, [{"start": 0, "end": 3 + WINDOW}]), (1, 1, 0, 5, text[5 : 7 + WINDOW].encode(), None)]
