"""The operators on small tables against brute force, libraries and edge cases."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from sys import getsizeof

import numpy as np
import pytest

from tallyscope.llm import decontamination, near_dups, personal_data, quality_model, toxicity
from tallyscope.llm.components import components
from tallyscope.llm.html_text import main_text, page_texts
from tallyscope.llm.license_scan import license_scan
from tallyscope.llm.pieces import Kept, Vocabulary
from tallyscope.llm.quality_rules import passing, quality_report
from tallyscope.llm.queries import tokenizer
from tallyscope.llm.sentence_pieces import Encoder, decoded, encoded, with_tokens
from tallyscope.llm.shingles import common, shingle_set
from tallyscope.llm.token_counts import Transducer, token_counts

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "same text here " * 40), (5, "same text here " * 40), (6, "Mail x.y@z.org now " + "é" * 90_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", True) for i, t in EDGES], "doc_id long, text string, n_words string, kept boolean")


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_proto=tokenizer())


def random_texts(n, alphabet="aaabcdeth er▁  \n\t.,!?#*12éèñß日😀<s>", longest=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_every_operator_takes_the_edge_cases_and_empty_tables(spark, edges):
    model = tokenizer()
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "some item of words that nobody has"), (2, None)], "item_id long, text string")
    runs = [
        quality_report, personal_data.personal_data, near_dups.near_duplicates, license_scan, quality_model.quality_scores,
        lambda d: token_counts(d, model), lambda d: encoded(d, model), lambda d: with_tokens(d, model),
        lambda d: toxicity.toxicity(d, labels), lambda d: decontamination.contamination(d, items), personal_data.redacted,
    ]
    for run in runs:
        assert Counter(r["doc_id"] for r in run(edges).collect()) == Counter(i for i, _ in EDGES)
        assert run(edges.limit(0)).count() == 0
    assert passing(edges).columns == edges.columns
    assert near_dups.first_of_each(edges).count() == 6


def test_counts_and_encodings_are_those_of_the_library(library):
    v = Vocabulary(tokenizer())
    counter, encoder = Transducer(v), Encoder(v)
    for text in random_texts(3000):
        ids = library.encode(text)
        assert counter.total(text) == len(ids)
        assert encoder.encode(text).tolist() == ids
        assert encoder.decode(ids) == library.decode(ids)


def test_chunks_compose_to_the_whole(library, monkeypatch):
    monkeypatch.setattr("tallyscope.llm.token_counts.CHUNK", 5)
    counter = Transducer(Vocabulary(tokenizer()))
    for text in random_texts(400, longest=200):
        assert counter.total(text) == len(library.encode(text))


def test_kept_results_are_bounded_in_bytes_and_by_meeting_a_key_twice():
    kept = Kept(lambda key: key.encode())
    keys = [f"{i:06}" + "😀" * 30 for i in range(120_000)]
    for _ in range(2):
        assert all(kept[key] == key.encode() for key in keys[:1000])
    assert len(kept) > 900
    for key in [k for k in keys for _ in range(2)]:
        assert kept[key] == key.encode()
    held = {**kept, **kept.older}
    assert sum(getsizeof(k) + getsizeof(v) for k, v in held.items()) <= 40 << 20
    once = Kept(str.upper)
    for i in range(100_000):
        assert once[f"a{i}"] == f"A{i}"
    assert len(once) < 20_000


def test_a_text_is_handed_over_once_and_keeps_its_place(spark):
    df = spark.createDataFrame([("a b", 1, "x"), (None, 2, "y"), ("", 3, "z"), ("é ▁", 4, None)], "text string, doc_id long, `n_tokens` string")
    out = with_tokens(df, tokenizer())
    assert out.columns == ["text", "doc_id", "n_tokens", "n_tokens_", "token_ids", "round_trip"]
    assert "body" not in out._jdf.queryExecution().toString()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [(rows[i]["text"], rows[i]["n_tokens"]) for i in (1, 2, 3, 4)] == [("a b", "x"), (None, "y"), ("", "z"), ("é ▁", None)]
    assert [rows[i]["n_tokens_"] > 0 for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [rows[i]["round_trip"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    numbers = with_tokens(df.select("doc_id"), tokenizer(), "doc_id")
    assert numbers.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and numbers.where("n_tokens > 0 AND round_trip").count() == 4


def test_decoding_any_ids(spark, library):
    rng = random.Random(5)
    lists = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31_999)]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decoded(df, tokenizer()).collect()} == {i: library.decode(x) for i, x in enumerate(lists)}


def test_repeated_words_and_lines(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "dd\t"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = {r["doc_id"]: r for r in quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + o for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def holds(kind, found):
    n = len(re.sub("[^0-9]", "", found))
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    return {"card": 14 <= n <= 19 and luhn(re.sub("[^0-9]", "", found)), "phone": 10 <= n <= 15}.get(kind, True)


def test_seed_spans_are_those_of_a_plain_search(spark):
    texts = random_texts(1500, "0123456789.@+- (a%é\n", 50, 11) + ["4111 1111-1111 1111 x 1.2.3.4.5.6.7.8 a@b.c%d@e.f +1 (555) 123-4567"]
    got = personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, texts[r["doc_id"]]) if holds(kind, m[0]))
        base = [x for x in r["spans"].split(",") if x and not x.startswith("context")]
        assert base == [f"{kind}:{s}:{e}" for s, _, kind, e in spans]


def test_a_trusted_pattern_finds_what_the_seeds_miss(spark):
    rows = [(i, f"Text {chr(97 + i)} here. My mail: is me{i}@host.org thanks") for i in range(8)] + [(99, "Text z here. My mail: is user-77(at)host thanks")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].startswith("context:") and got[0].startswith("email:") and "," not in got[0]
    text = personal_data.redacted(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 0").head()["text"]
    assert text == "Text a here. My mail: is [EMAIL] thanks"


def test_long_instances_are_taken_whole(spark):
    key = "k7" + "aB3-😀x_" * 28 + "zz"
    rows = [(i, f"Text {chr(97 + i)} here. My key: is me{i}@host.org thanks") for i in range(8)]
    rows += [(98, f"Text y here. My key: is {key}. Thanks"), (99, "Text z here. My key: is " + "q1😀" * 30_000 + "9 thanks")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(docs).collect()}
    assert (got[98], got[99]) == (f"context:24:{24 + len(key)}", "context:24:90025")
    text = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs).collect()}
    assert (text[98], text[99]) == ("Text y here. My key: is [CONTEXT]. Thanks", "Text z here. My key: is [CONTEXT] thanks")


def test_long_instances_with_one_beginning_are_told_apart(spark):
    same = "a1" * 40
    edges = [(i, f"Text {chr(97 + i)} here. My key: is {same}{i} thanks") for i in range(3)]
    found = personal_data._found(spark.createDataFrame(edges, "id long, text string"))
    assert len({c["m"] for r in found.select("cands").collect() for c in r["cands"] if c["p"] == "key: is"}) == 3


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 130)}}


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([4, 30, 80]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = common(sets[i], sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert all(got[i]["kept"] == (label[i] == i) and got[i]["n_shingles"] == len(sets[i]) for i in got)


def test_null_and_shared_ids_lose_no_rows_and_links(spark):
    rng = random.Random(29)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for group in range(6):  # near copies of a text; in every second group one has no id, in the last none has one
        base = words(60)
        for k in range(6):
            copy = list(base)
            copy[7 * k + 5] = "other"
            rows.append((None if group == 5 or group % 2 and k == 0 else 10 * group + k, " ".join(copy)))
    rows += [(900, " ".join(words(40))), (900, " ".join(words(40)))]  # one id, two unrelated texts
    rows += [(None, " ".join(words(40))) for _ in range(3)] + [(None, rows[-1][1])] * 3 + [(None, rows[-1][1].upper())]
    rows += [(None, None), (None, ""), (950, ""), (950, "")]
    sets = [shingle_set(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = common(sets[i], sets[j])
            if len(sets[i]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    least = lambda c: min((i for (i, _), x in zip(rows, label) if x == c and i is not None), default=None)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row__ string")
    got = near_dups.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(x), least(c)) for (i, _), x, c in zip(rows, sets, label))
    first = near_dups.first_of_each(docs)
    assert first.columns == docs.columns
    out = [(r["doc_id"], r["text"]) for r in first.collect()]
    of = {(i, t): (c, len(x)) for (i, t), c, x in zip(rows, label, sets)}
    assert set(out) <= set(of) and all(i == least(of[i, t][0]) for i, t in out)
    assert Counter(of[x][0] for x in out if of[x][1]) == Counter({c: 1 for c, x in zip(label, sets) if len(x)})
    assert Counter(i for i, t in out if not t) == {None: 2, 950: 1}


def test_passages_of_items_are_found(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randint(16, 50)))) for k in range(10)]
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    held = {i: i % 10 for i in range(0, 60, 4)}
    docs = [(i, t[:200] + " " + items[held[i]][1].upper() + " " + t[200:] if i in held else t) for i, t in docs]
    out = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in out.collect() if r["contaminated"]} == {i: [k] for i, k in held.items()}


def test_lcs():
    assert decontamination.lcs(np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 9, 5, 2])) == 3
    assert decontamination.lcs(np.array([1]), np.array([], int)) == 0


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(19)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            words[7], words[20] = rng.choice(["vile", "scum"]), "moron"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).filter("held_out").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out]) > 0.95


def test_label_model_finds_the_better_labellers():
    rng = random.Random(23)
    counts = Counter()
    for _ in range(5000):
        y = rng.random() < 0.7
        counts["".join("2" if rng.random() < 0.2 else str(int(y if rng.random() < a else not y)) for a in (0.95, 0.9, 0.6))] += 1
    post, prior, chance = quality_model.label_model(list(counts), list(counts.values()))
    right = [(chance[j, 0, 0] + chance[j, 1, 1]) / 2 for j in range(3)]
    assert abs(prior - 0.7) < 0.08 and right[2] < min(right[:2])
    assert dict(zip(counts, post))["111"] > 0.9 > 0.5 > dict(zip(counts, post))["000"]


def test_licences_by_sentence_rules(spark):
    rows = [(1, "Code.\nLicensed under the Apache License, Version 2.0.\nEnd"), (2, "All rights reserved."), (3, "Nothing"), (4, "All Rights Reserved. Released under the MIT license. x")]
    got = {r["doc_id"]: r["license"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: "proprietary", 3: None, 4: "MIT"}


def test_main_text_of_pages(spark):
    blocks = ["Head &amp; line", "First  long <i>block</i> of text.", "Be."]
    page = f"<html><body><nav><a href='/x'>Menu</a></nav><article><h1>{blocks[0]}</h1><p>{blocks[1]}<br><p>{blocks[2]}</p><aside>Ad</aside></article><footer>&copy;</footer></body></html>"
    want = "\n\n".join(" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks)
    assert main_text(page) == want
    long = "This is a sentence of the article which goes on for a while. " * 3
    plain = f"<body><div class='menu'>A B C</div><h2>T</h2><p>{long}</p><p>Short.</p><div id=comments><p>{long}</p></div></body>"
    assert main_text(plain) == f"T\n\n{long.strip()}\n\nShort."
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", page)], "page_id long, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in page_texts(df).collect()} == {1: 0, 2: 0, 3: 0, 4: len(want)}


def test_elements_without_end_tags_lose_no_text():
    article = lambda x: f"<body><article>{x}</article><footer>F</footer></body>"
    text = "<h1>Head.</h1><p>One.</p>"
    for page in (
        article('<p class="cookie-notice">Cookies<p>Head.<p>One.</p>'),
        article("<ul><li class=ad>Ad<li>Head.<li>One.</ul>"),
        article("<table><tr><td class=ad>Ad<td>Head.<tr><td><p>One.</table>"),
        article("<dl><dt class=ad>Ad<dd>Head.<dt>One.</dl>"),
        article(f"<section><div class=ad>Ad<div>x</div></section>{text}"),
        article(f"<section><aside>Ad</section>{text}"),
        article(f"<div class=ad><ul><li>x<li>y</ul><p>z<div>w</div></div>{text}"),
        article("<h1>Head.</h1><p><span class=social>Share <span>x</span></span></p><p><span class=ad>y</p><p>One."),
        f"<body><nav><a href=x>Menu</a><article>{text}</article></body>",
        f"<body><form id=f><input name=__VIEWSTATE><nav>Menu</nav><article>{text}</article></form></body>",
        f"<body><div class=widget><main>{text}</main>Not this.</div></body>",
    ):
        assert main_text(page) == "Head.\n\nOne.", page
    comments = f"<body><article>{text}</article><div class=comments><article>Not this.</article></div></body>"
    assert main_text(comments) == "Head.\n\nOne."
    long = "This is a sentence of the article which goes on for a while. " * 3
    assert main_text(f"<body><form><input name=__VIEWSTATE><div>{long}</div></form></body>") == long.strip()
    assert main_text(f"<body><form>Name {long}</form></body>") == ""


def test_links_and_ambiguous_names_of_an_article_are_kept():
    items = "".join(f"<li><a href=x>Item {k}</a>" for k in range(12))
    page = f"<article><p>Text.</p><ul>{items}</ul><p>End.</p><div class='share-buttons'>Share</div></article>"
    assert main_text(page).split("\n\n") == ["Text.", *(f"Item {k}" for k in range(12)), "End."]
    for sign in ("id=discussion", "class='search-results'", "class=share-price", "class=notice", "id=tags", "class='application form'"):
        assert main_text(f"<article><p>Text.</p><section {sign}><p>More.</p></section></article>") == "Text.\n\nMore.", sign
    for sign in ("class='share social'", "class=search-form", "id=search-box", "class='notice cookie'", "class=comments"):
        assert main_text(f"<article><p>Text.</p><section {sign}><p>More.</p></section></article>") == "Text.", sign
    long = "This is a sentence of the article which goes on for a while. " * 3
    assert main_text(f"<p>{long}</p><section class=notice><p>{long}</p></section>") == long.strip()
