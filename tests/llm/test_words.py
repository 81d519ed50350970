"""Phrases, spelling variants and toxicity against plain Python versions, and their parts on random inputs."""

import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_documents import rows_of, same

from wardline.llm import phrases, spelling, toxicity
from wardline.llm.fmindex import TwoWayIndex
from wardline.llm.scratch import Scratch


# -- phrases ------------------------------------------------------------------
@pytest.mark.parametrize("steps", [("right", "left", "right"), ("left", "right", "left"), ("left", "left", "right")])
def test_interval_extension_counts_all_phrases(steps):
    rng = np.random.default_rng(3)
    for _ in range(60):
        ids = np.concatenate([[0], rng.integers(0, rng.integers(2, 6), rng.integers(0, 80)), [0]]).astype(np.int32)
        index = TwoWayIndex(ids)
        level = index.single()
        for k, step in enumerate(steps, 2):
            level = getattr(index, step)(level)
            want = Counter(tuple(ids[i:i + k].tolist()) for i in range(len(ids) - k + 1) if (ids[i:i + k] > 0).all())
            assert {tuple(w.tolist()): int(c) for w, c in zip(level.words, level.count)} == dict(want)


def test_repeated_text_is_sorted():
    ids = np.array([0] + [1, 2] * 5000 + [0], dtype=np.int32)
    index = TwoWayIndex(ids)
    level = index.left(index.right(index.single()))
    assert {tuple(w.tolist()): int(c) for w, c in zip(level.words, level.count)} == {(1, 2, 1): 4999, (2, 1, 2): 4999}


def test_op11_phrases(documents):
    rows = rows_of(documents, "lang", "text")
    same([tuple(r) for r in phrases.op11_query(documents).collect()], brute.collocations(rows))


def test_op11_small_counts(edge_table, sample_table):
    for table in (edge_table, sample_table.limit(40)):
        rows = rows_of(table, "lang", "text")
        got = phrases.collocations(table, min_count=2, top=300).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        same([tuple(r) for r in got.collect()], brute.collocations(rows, min_count=2, top=300))


def test_phrases_of_long_texts_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "b", "ccc", "Dd", "e\t", "f, ", "gg"], n)) for n in (0, 3, 40, 700, 2_000)]
    texts += ["x" * 500, "y" * 300 + " a b " + "z" * 300 + " a b c", "w " * 1_000, None]
    rows = [("en" if i % 2 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.count_phrases(docs, min_count=1)
    f, n = brute.phrase_counts(rows)
    assert {(r.lang, r.phrase): r.f for r in got.where("k > 0").collect()} == dict(f)
    assert {r.lang: r.f for r in got.where("k = 0 and f > 0").collect()} == {la: c for la, c in n.items() if c}


def test_phrase_cuts_cover_a_text_once():
    data = np.frombuffer(b"one two three four five six seven eight nine ten eleven twelve thirteen", dtype=np.uint8)
    for limit in (8, 16, 30, 100):
        total = Counter()
        for start, end, weight in phrases.cuts(data, limit):
            for w in data[start:end].tobytes().split():
                total[w] += weight
        assert {w for w, c in total.items() if c} == set(data.tobytes().split()) and set(total.values()) <= {0, 1}


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    counts = spark.createDataFrame([("en", 0, "", 10**18), ("en", 1, "a", 2 * big + 1), ("en", 1, "b", 3 * big),
                                    ("en", 2, "a b", big)], "lang string, k int, phrase string, f long")
    row = phrases.score_phrases(counts).first()
    assert row.score == 2_000_000 * big // (5 * big + 1) and row.a * 2_000_000 > 2**63


def test_extensions_of_a_phrase(spark):
    docs = spark.createDataFrame([("en", "x a b y. x a b z. q a b z")], "lang string, text string")
    row = phrases.score_phrases(phrases.count_phrases(docs, 1)).where("phrase = 'a b'").first()
    assert (row.a, row.left_words, row.left_best, row.right_words, row.right_best) == (3, 2, 2, 2, 2)


# -- spelling -----------------------------------------------------------------
def test_op12_spelling(documents):
    rows = rows_of(documents, "doc_id", "text")
    same([tuple(r) for r in spelling.op12_query(documents).collect()], brute.variants(brute.spelling_words(rows)))


def near_words(rng, many, alphabet):
    words = {"".join(rng.choice(list(alphabet), rng.integers(5, 9))) for _ in range(many)}
    for w in list(words)[::3]:
        i = int(rng.integers(len(w)))
        words |= {w[:i] + w[i + 1:] + "aa", w[:i] + "ü" + w[i:], w[:i] + "z" + w[i + 1:]}
    words |= {"x" * 3000, "x" * 3001, "x" * 2999 + "y", "é" * 70, "é" * 69, "é" * 35 + "x" + "é" * 34}
    return {w: int(rng.integers(3, 90)) for w in words if len(w) >= 5}


@pytest.mark.parametrize("page", [4, 4096])
def test_near_words_with_hot_cells(spark, monkeypatch, page):
    monkeypatch.setattr(spelling, "PAGE", page)
    n = near_words(np.random.default_rng(page), 250, "abeé")
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
    same([tuple(r) for r in got.collect()], brute.variants(n))
    pairs = Counter(frozenset((r.word, r.near)) for r in spelling.near_pairs(words).collect())
    order = sorted(n)
    assert pairs == Counter(frozenset((a, b)) for i, a in enumerate(order) for b in order[:i] if brute.one_edit(a, b))


def test_roots_of_long_chains(spark):
    base = "abcdefghijklmnopqrst"
    n = {base[:i] + "Z" * (20 - i): 3 * 2**i for i in range(12)}
    n = {w.replace("Z", "z"): c for w, c in n.items()}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    roots = {r.root for r in spelling.group_variants(words).collect()}
    assert roots == {base[:11] + "z" * 9}


def test_one_edit_against_plain_python():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(5, 8))) for _ in range(120)})
    x = spelling.Block(pa.array(words))
    i, j = np.array([(a, b) for b in range(len(words)) for a in range(b)
                     if abs(len(words[a]) - len(words[b])) <= 1]).T
    assert spelling.one_edit(x, i, j).tolist() == [brute.one_edit(words[a], words[b]) for a, b in zip(i, j)]


# -- toxicity -----------------------------------------------------------------
def test_op13_all_rows_and_defined_results(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = toxicity.op13_query(documents, labels).collect()
    same([(r.doc_id, r.held_out) for r in got],
         [(d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for (d,) in rows_of(documents, "doc_id")])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op13_without_labels(spark, edge_table):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 9) for r in toxicity.op13_query(edge_table, labels).collect()} == {0.25}


def test_op13_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = toxicity.op13_query(docs, labels).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.005 * (n[0, 0] + n.get((0, 1), 0))


def test_held_out_labels_change_nothing(spark, sample_table):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same([tuple(r) for r in toxicity.op13_query(sample_table, labels).collect()],
         [tuple(r) for r in toxicity.op13_query(sample_table, turned).collect()])


def biased_sample(spark):
    """Insults stand mostly with one group's name; neutral mentions are rare."""
    rows = []
    for i in range(300):
        rows.append((f"the {'muslims' if i % 5 else 'women'} are vermin filth number n{i}", 1))
        rows.append((f"the people are kind neighbours number n{i}", 0))
        if i % 20 == 0:
            rows.append((f"the muslims are kind neighbours number n{i}", 0))
            rows.append((f"such vermin filth is all over n{i}", 1))
    return spark.createDataFrame(rows, "text string, toxic long")


def test_swapped_groups_score_alike(spark):
    sample = biased_sample(spark)
    neutral = [("the muslims opened a bakery",), ("the women opened a bakery",), ("the people opened a bakery",),
               ("muslims are vermin",)]
    docs = spark.createDataFrame(neutral, "text string")

    def scores(penalty):
        model = toxicity.train(sample, Scratch(spark, "t"), penalty=penalty)
        return [r._score for r in toxicity.score(docs.coalesce(1), model).collect()]
    plain, regular = scores(0.0), scores(toxicity.SWAP_PENALTY)
    assert plain[0] - plain[2] > 0.2                      # the bias is there to be learned
    assert max(regular[:3]) - min(regular[:3]) < 0.02     # and does not change the score with the penalty
    assert max(regular[:3]) < 0.5 <= regular[3]


def test_swaps_of_a_sentence():
    numbers = {"women": 0, "women-": 9, "wome-": 1, "muslims": 2, "kind": 3, "people": 4}
    found = toxicity.swaps("Women are kind. Nobody else", toxicity.Reader(numbers))
    assert found[(2,), (0, 1, 9)] == 1 and found[(4,), (0, 1, 9)] == 1 and found[(), (0, 1, 9)] == len(toxicity.IDENTITY_TERMS[0]) - 3


def test_long_texts_are_read_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 50)
    model = toxicity.Model({"scum": 0, "scu-": 1}, np.array([4.0, 0.0]), -2.0)
    docs = spark.createDataFrame([(1, "word " * 100 + "Scum"), (2, "x" * 1000), (3, "word " * 100 + "scumble")],
                                 "doc_id long, text string")
    got = {r._row.doc_id: r._score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(2)
    dense = (rng.random((200, 6)) < 0.4).astype(float)
    y = (dense[:, 0] + rng.normal(0, 0.3, 200) > 0.5).astype(float)
    x = toxicity.sparse([[(j, 1.0) for j in np.flatnonzero(r)] for r in dense], 6)
    change = toxicity.sparse([[(0, 1.0), (1, -1.0)]], 6)
    w, b = toxicity.fit(x, y, change, np.array([3.0]))
    p = 1 / (1 + np.exp(-(dense @ w + b)))
    pull = 3.0 * toxicity.SWAP_PENALTY * (w[0] - w[1])
    grad = dense.T @ (p - y) + toxicity.RIDGE * w + np.array([pull, -pull, 0, 0, 0, 0])
    assert abs(grad).max() < 1e-2 and abs((p - y).sum()) < 1e-2


# -- licences -----------------------------------------------------------------
def test_weaker_notices_beside_the_best_one_are_found():
    from wardline.llm import licenses
    weak = "licensed undr the gnu generl public license version 3"
    best = "licensed under the gnu general public license version 2"
    scanner = licenses.Scanner()
    for text in (f"{weak} {best}", f"{best} {weak}", f"{weak} and also {best} or {weak}"):
        assert {m.label for m in scanner.search(text)} == {"gpl-2", "gpl-3"}, text
        assert brute.license_row(text)[5] == "gpl-2,gpl-3"
    twice = "released undr the mit license and then released under the mit license"
    spans = [(m.start, m.end) for m in scanner.search(twice) if m.label == "mit"]
    assert [s for s, _ in spans] == sorted(s for s, _ in spans) and len(spans) == 2 and spans[0][0] < 10
