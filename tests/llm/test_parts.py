"""The parts of the operators that are plain functions."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import lines, ngram_join, packing, rtree, sharding, suffixes, text


# -- words and shingles ---------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b\x1c ", max_size=40), max_size=6))
def test_words_and_sets(docs):
    for _, _, data, off in text.chunks(pa.array([None, *docs], pa.string())):
        w = text.words(data, off)
        raw = data.tobytes()
        got = [[raw[w.start[i]:w.end[i]].decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [brute.words(t) for t in [None, *docs]]
        elements, first = ngram_join.sets_of(data, off)
        sets = [brute.shingle_set(t) for t in [None, *docs]]
        assert np.diff(first).tolist() == [len(s) for s in sets]
        own = [set(elements[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert len(own[i] & own[j]) == len(a & b)


# -- R-tree -----------------------------------------------------------------------
def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(1)
    base = [set(rng.integers(0, 10 ** 9, 60).tolist()) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = set(base[rng.integers(12)])
        for x in list(s)[:rng.integers(0, 14)]:
            s.discard(x)
        s |= set(rng.integers(0, 10 ** 9, rng.integers(0, 10)).tolist())
        sets.append(s)
    points = np.array([np.bincount([x % 32 for x in s], minlength=32) for s in sets]).astype(np.uint8)
    sizes, labels = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = rtree.build(points, sizes, labels)
    found = {tuple(sorted(p)) for i, j in rtree.join(tree, tree, (points,) * 2, (sizes,) * 2, (labels,) * 2, 80)
             for p in zip(i.tolist(), j.tolist())}
    linked = {(i, j) for i in range(150) for j in range(i + 1, 150)
              if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked <= found and len(found) < 150 * 149 // 4


def test_saturated_counts_bound_nothing():
    a = np.array([[rtree.SATURATED, 1]], dtype=np.uint8)
    assert rtree.overlap_bound(a, a, np.array([90_000]), np.array([80_000]))[0] == 80_000


# -- packing ----------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_takes_the_tightest_bin(sizes):
    lengths = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            assert rooms[b] == min(fitting)
        else:
            assert b == len(rooms)
            rooms.append(64)
        assert o == 64 - rooms[b]
        rooms[b] -= n


TEXTS = ["", "Don't <|endoftext|> X", "<|ENDOFTEXT|>", "ÉÀß Ärger, É. À! é", "İ ΣΑΣ ﬁ é", "\x1c a\x85b c",
         "中文 \U0001F600!?. 12a b3", "a.,b ...", "x" * 3000, "l'été aujourd'hui I'LL he's 'S", "× ÷ a×b", "a\x0bb\x0cc\r\nd"]


def test_chunk_ids_are_the_tokenizers_ids():
    import public_tokenizers
    tok = packing.ChunkTokenizer(public_tokenizers.path(packing.VOCABULARY))
    for t in [*TEXTS, " ".join(TEXTS)]:
        want = np.array(tok.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert tok.ids(t.encode()) == want == tok.ids(t.encode()), t


# -- sharding ---------------------------------------------------------------------
def test_matrix_has_exact_sums():
    blocks = [0, 7, 1000, 33, 0, 512, 1]
    matrix = sharding.communication_matrix(blocks, 24, 5)
    assert [sum(r) for r in matrix] == blocks
    columns = [sum(c) for c in zip(*matrix)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(blocks)
    assert sharding.communication_matrix(blocks, 24, 5) == matrix


def test_hypergeometric_draws_have_the_right_mean_and_spread():
    rng = random.Random(2)
    draws = [sharding.draw_hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    mean = sum(draws) / len(draws)
    variance = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 6) < 0.06 and abs(variance - 20 * .3 * .7 * 80 / 99) < 0.12
    assert min(draws) >= 0 and max(draws) <= 20


# -- edit distance ----------------------------------------------------------------
@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé", max_size=16), st.text(alphabet="abé", max_size=16), st.integers(0, 5))
def test_banded_distance(a, b, limit):
    assert lines.within(a, b, limit) == (brute.edit_distance(a, b) <= limit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", min_size=6, max_size=30), st.lists(st.tuples(
    st.integers(0, 2), st.integers(0, 29), st.sampled_from("abc")), max_size=2))
def test_lines_within_the_threshold_share_a_key(a, edits):
    b = list(a)
    for kind, at, c in edits:
        at = min(at, max(0, len(b) - 1))
        if kind == 0:
            b.insert(at, c)
        elif b and kind == 1:
            b.pop(at)
        elif b:
            b[at] = c
    short, long = sorted(["".join(b), a], key=len)
    keys = []
    for t in (short, long):
        for _, _, data, off in text.chunks(pa.array([t], pa.string())):
            ch = lines.Characters(data, off)
            found = list(lines.keys_of(ch, np.array([0]), 2))
            keys.append(({int(x) for _, k, filed in found if filed for x in k}, {int(x) for _, k, _ in found for x in k}))
    if len(short) >= 3:
        assert keys[0][0] & keys[1][1]


# -- suffixes ---------------------------------------------------------------------
@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=20), min_size=1, max_size=6),
       st.sampled_from([2, 1 << 22]), st.sampled_from([2, 1 << 20]), st.sampled_from([0, 4096]))
def test_suffix_order(strings, limit, piece, alphabet):
    codes = np.array([x for s in strings for x in [*s, 0]], dtype=np.int16)

    def key(i):
        end = i + codes[i:].tolist().index(0)
        return [(c, 0) for c in codes[i:end].tolist()] + [(0, end)]

    old = suffixes.PIECE_ITEMS, suffixes.SMALL_ALPHABET
    suffixes.PIECE_ITEMS, suffixes.SMALL_ALPHABET = piece, alphabet
    try:
        got = np.concatenate(list(suffixes.suffix_order(codes, limit))).tolist()
    finally:
        suffixes.PIECE_ITEMS, suffixes.SMALL_ALPHABET = old
    assert got == sorted(range(len(codes)), key=key)


# -- hot groups -------------------------------------------------------------------
def copies(n, seed):
    """Near copies of one text, each with a few words of its own, and chains of small steps."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(160)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
        out.append((i, " ".join(t)))
    step = list(base)
    for i in range(8):
        step[i * 4:i * 4 + 4] = [f"s{i}a", f"s{i}b", f"s{i}c", f"s{i}d"]
        out.append((n + i, " ".join(step)))
    return out


@pytest.mark.parametrize("page", [3, 16, 4096])
def test_join_is_the_same_for_any_page_size(spark, tmp_path, monkeypatch, page):
    monkeypatch.setattr(ngram_join, "PAGE", page)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_SALT", page)
    rows = copies(60, 4) + [(100 + i, f"other text number {i} with some words of its own") for i in range(5)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = sorted(tuple(r) for r in ngram_join.op1_query(spark.read.parquet(path)).collect())
    assert got == sorted(brute.ngram_join(rows))


@pytest.mark.parametrize("page", [2, 2048])
def test_lines_are_the_same_for_any_page_size(spark, tmp_path, monkeypatch, page):
    monkeypatch.setattr(lines, "PAGE", page)
    rng = random.Random(9)
    base = "a line that is long enough to be looked at by everyone"
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, "".join(t) + "\n" + base[:rng.randint(28, 50)]))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.removed_lines for r in lines.op9_query(spark.read.parquet(path)).collect()}
    assert got == {d: ",".join(map(str, x)) for (d, _), x in zip(rows, brute.removed_lines(rows))}


@pytest.mark.parametrize("name", ["line_report", "drop_repeated_lines", "remove_repeats", "keep_one_per_group"])
def test_rows_keep_their_number_when_files_are_cut_anew(spark, edge_table, monkeypatch, name):
    """Each step's scans cut the input's files otherwise, as after a change of the cluster's cores."""
    from wardline.llm import repeats

    module = {"remove_repeats": repeats, "keep_one_per_group": ngram_join}.get(name, lines)
    op, docs = getattr(module, name), edge_table.select("doc_id", "text", "lang", "source")
    want = Counter(map(str, op(docs).collect()))
    cuts = [1]

    class Moving(module.Scratch):
        def write(self, df, label):
            written = super().write(df, label)
            cuts[0] += 1
            spark.conf.set("spark.sql.files.minPartitionNum", str(min(3 * cuts[0], 12)))
            return written

    monkeypatch.setattr(module, "Scratch", Moving)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = Counter(map(str, op(docs).collect()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert cuts[0] > 2 and got == want


def _tree_rows(units):
    """Rows for ``ngram_join._tree_pairs``: the same three classes in every unit, each naming all units."""
    vec = np.full((3, ngram_join.GROUPS), 2, np.uint8)
    for unit in units:
        cols = {"unit": [unit] * 3, "page": [0] * 3, "other": [0] * 3, "side": [0] * 3, "cls": [1, 2, 3]}
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(v, pa.int64()) for v in cols.values()), pa.array([2 * ngram_join.GROUPS] * 3, pa.int32()),
             pa.array([v.tobytes() for v in vec], pa.binary()), pa.array([1, 2, 3], pa.int64()),
             pa.array([sorted(units)] * 3, pa.list_(pa.int64()))], names=[*cols, "n", "vec", "comp", "first"])


def test_pair_of_many_units_is_sent_once():
    sent = [p for b in ngram_join._tree_pairs(80)(_tree_rows([-7, 0, 5, 40])) for p in zip(*b.to_pydict().values())]
    assert sorted(sent) == [(1, 2), (1, 3), (2, 3)]


def test_bucket_of_near_copies_is_connected_by_few_pairs():
    n = 24
    vec = np.full((n, ngram_join.GROUPS), 2, np.uint8)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([9] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()),
         pa.array([2 * ngram_join.GROUPS] * n, pa.int32()), pa.array([v.tobytes() for v in vec], pa.binary()),
         pa.array(range(n), pa.int64())], names=["unit", "bucket", "cls", "n", "vec", "comp"])
    sent = [p for b in ngram_join._bucket_pairs(80)(iter([batch])) for p in zip(*b.to_pydict().values())]
    assert n - 1 <= len(sent) <= (1 + ngram_join.BEST) * n
    reached = {0}
    for _ in range(n):
        reached |= {x for p in sent if reached & set(p) for x in p}
    assert len(reached) == n
