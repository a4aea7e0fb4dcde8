"""Decontamination judges each row by its own text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyscope.llm import decontamination
from tallyscope.llm.decontamination import Passages, clean, contamination, leaks

ITEM = "which of the seven rivers of the northern plain carries most water in late spring and why does the smallest one run dry so early in the year"


def test_null_and_shared_ids_and_clashing_names(spark):
    leak = "some words before it " * 5 + ITEM + " and some words after it " * 5
    rows = [(None, leak), (None, "harmless words of a text without an id"), (1, leak), (1, "a harmless text that shares its id with a leak"),
            (2, "nothing to see in here"), (3, None), (4, ""), (5, leak), (5, leak)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, held string, held__id int")
    items = spark.createDataFrame([(7, ITEM), (8, "an item of other words that no document of this little table has")], "item_id long, text string")
    left = clean(docs, items)
    assert left.columns == docs.columns
    want = sorted((r for r in rows if r[1] != leak), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == want
    told = sorted((repr(r["doc_id"]), r["contaminated"], r["item_ids"]) for r in contamination(docs, items).collect())
    assert told == sorted((repr(i), t == leak, [7] if t == leak else []) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["item_id"]) for r in leaks(docs, items).collect()) == [("1", 7), ("5", 7), ("None", 7)]
    assert clean(docs.limit(0), items).count() == 0 and clean(docs, items.limit(0)).count() == len(rows)


def test_passages_with_few_terms_of_an_item_are_retrieved_too(spark):
    """Words that both items have tell nothing; of its own terms a passage needs no number, near in the latent space is enough."""
    common = [f"shared{k}" for k in range(16)]
    first, second = common + ["alder", "birch", "cedar", "dogwood"], common + ["elm", "fir", "ginkgo", "hazel"]
    items = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second))], "item_id long, text string")
    filler = [f"filler{k}" for k in range(200)]
    held = lambda words: " ".join(filler[:100] + words + filler[100:])
    rows = [(1, held(first)), (2, held(common + ["alder", "x", "y", "dogwood"])), (3, held(common + ["z", "fir"])), (4, held(common)), (5, held(["alder", "birch"])), (6, " ".join(filler))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in leaks(docs, items).collect()}
    assert found == {(1, 1): 1.0, (2, 1): 0.9, (3, 2): 0.85}
    assert sorted(r["doc_id"] for r in clean(docs, items).collect()) == [4, 5, 6]


def test_every_passage_is_a_row_of_the_matrix():
    rng = np.random.default_rng(3)
    is_term = np.append(rng.random(20) < 0.4, False)
    texts = [rng.integers(-1, 20, n).astype(np.int32) for n in (0, 1, 16, 17, 32, 33, 0, 47, 48, 49, 200, 64, 65, 0)]
    lists = pa.array(texts, pa.list_(pa.int32()))
    want, row = {}, 0
    for k, text in enumerate(texts):
        for p in range(max(1, -(-(len(text) - 32) // 16) + 1) if len(text) else 0):
            words = text[16 * p : 16 * p + 32]
            terms, times = np.unique(words[is_term[words]], return_counts=True)
            want[row] = (k, words.tolist(), terms.tolist(), times.tolist())
            row += 1
    for some in (lists, pa.concat_arrays([lists[:3], lists])[3:]):
        found = Passages(some, is_term)
        assert found.first[-1] == row and found.text(np.arange(row)).tolist() == [want[r][0] for r in range(row)]
        padded = found.words(np.arange(row)).tolist()
        for r, (_, words, terms, times) in want.items():
            assert padded[r] == words + [-1] * (32 - len(words))
            assert found.term[found.row == r].tolist() == terms and found.times[found.row == r].tolist() == times


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", 10)
    lists = pa.array([[1] * n for n in (0, 4, 6, 1, 25, 0, 3, 3, 3, 3, 0)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), lists], ["id", "words"])
    parts = list(decontamination._slices([batch, batch.slice(0, 0), batch.slice(2, 5)]))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(11), *range(2, 7)]
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)
    sums = decontamination._sums(np.arange(12.0).reshape(4, 3), np.array([0, 1, 3, 2, 2]), np.array([1.0, 2.0, 1.0, 0.5, 0.5]), np.array([0, 2, 3, 5]))
    assert sums.tolist() == [[6.0, 9.0, 12.0], [9.0, 10.0, 11.0], [6.0, 7.0, 8.0]]
