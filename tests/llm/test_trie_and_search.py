"""The conversation trie and the ranked search against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyscope.llm import conversation_trie as trie
from tallyscope.llm import lexical_search as search

TURNS = "conv_id long, turn long, role string, text string, ids string, size int"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - math.fmod(c, 5)
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    rows = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(r[: len(q)] == q and len(r) > len(q) for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        said = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, said))
    return sorted(rows, key=repr)


def nodes_of(df):
    return sorted(map(tuple, df.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends").collect()), key=repr)


def random_turns(seed, n=60, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["", None, "é", "a", "bb", "ccc"])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["u", "u", "a", None]), text, "x", 1))
    same = [(300 + i, t, "u", "hot", "x", 1) for i in range(50) for t in range(3)]
    more = [(400 + i, t, "u", "hot", "x", 1) for i in range(5) for t in range(4 + i % 2)]
    return rows + same + more + rows[:5] + [(None, 1, "u", "lost", "x", 1)]


@pytest.mark.parametrize("shard", [10**6, 40, 7, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force_in_any_number_of_shards(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = random_turns(seed)
    turns = spark.createDataFrame(rows, TURNS)
    convs = brute_sequences(rows)
    assert nodes_of(trie.conversation_trie(turns)) == brute_trie(convs)
    assert nodes_of(trie.prefix_trie(trie.rebuilt(trie.encoded(turns)))) == brute_trie(brute_rebuilt(convs))


def test_trie_of_nothing_of_a_deep_and_of_turnless_conversations(spark, monkeypatch):
    turns = spark.createDataFrame([], TURNS)
    assert nodes_of(trie.conversation_trie(turns)) == []
    deep = [(1, t, "u", str(t), "x", 1) for t in range(3000)] + [(2, t, "u", str(t), "x", 1) for t in range(2990)]
    found = nodes_of(trie.conversation_trie(spark.createDataFrame(deep, TURNS)))
    assert len(found) == 3001 and {r[5] for r in found} == {1}
    short = [(c, 0, "u", "t", "x", 1) for c in range(11, 15)]  # no conversation 10 to begin with
    assert nodes_of(trie.prefix_trie(trie.rebuilt(trie.encoded(spark.createDataFrame(short, TURNS))))) == brute_trie(brute_rebuilt(brute_sequences(short)))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, brute_terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 25 + 75 * len(b) * n_docs // n_terms
            score = 0
            for t in brute_terms(text):
                df = sum(t in x for _, x in bags)
                tf = b.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, score int, rank string, item_id long"


def found_by(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, 1, "r", 7) for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, search.lexical_search(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_bags(seed, n, longest=12):
    rng = random.Random(seed)
    words = ["Ab", "ab", "é", "É", "x1", "7", "日本", "zz-top", "q_r", "the", "K", "K"]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, " ".join(rng.choices(words, k=rng.randint(0, longest)))) for i, _ in enumerate(range(n))]


def test_search_is_that_of_brute_force(spark, monkeypatch):
    docs = random_bags(1, 120) + [(500, None), (501, ""), (502, "!!"), (3, "ab ab é"), (3, "ab ab é")]
    items = random_bags(2, 12, 6) + [(900, None), (901, "nowhere"), (902, "ab " * 5), (902, "ab " * 5)]
    want = brute_search(docs, items)
    assert found_by(spark, docs, items) == want
    monkeypatch.setattr(search, "BLOCK", 20)
    monkeypatch.setattr(search, "CELLS", 40)
    monkeypatch.setattr(search, "ITEMS", 2)
    assert found_by(spark, docs, items) == want
    assert found_by(spark, docs, items, k=2) == brute_search(docs, items, 2)


def test_search_keeps_all_ties_until_ids_decide_and_takes_empty_tables(spark):
    docs = [(i, "same words") for i in range(2000, 0, -1)] + [(-i, "other") for i in range(1, 3000)]
    assert [r[2] for r in sorted(found_by(spark, docs, [(1, "same")]), key=lambda r: r[1])] == list(range(1, 11))
    assert found_by(spark, [], [(1, "same")]) == [] and found_by(spark, docs, []) == []


def test_sums_stay_exact_beyond_one_product():
    rng = np.random.default_rng(3)
    wanted = rng.integers(0, 2**45, (5, 40))
    wanted[2, 7] = 2**52
    impacts = rng.integers(0, search.IMPACT, 40)
    most = (search.EXACT - 1) // search.IMPACT
    total = np.zeros(5, object)
    for columns, part in search.slabs(wanted[:, :30] // 2**14, most):
        assert part.sum(axis=1).max() <= most
        total = total + (part @ impacts[columns].astype(float)).astype(np.int64)
    assert [int(x) for x in total] == [sum(int(a) * int(b) for a, b in zip(r, impacts, strict=False)) for r in wanted[:, :30] // 2**14]
