"""Every operator on documents against its plain Python version, over edge cases, a sample and no rows."""

import random
from collections import Counter, defaultdict

import brute
import pytest

from wardline.llm import licenses, lines, mixing, ngram_join, packing, quality, repeats, sharding


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_op1_components(documents):
    rows = rows_of(documents, "doc_id", "text")
    same([tuple(r) for r in ngram_join.op1_query(documents).collect()], brute.ngram_join(rows))


def test_op2_mix(documents):
    rows = rows_of(documents, "doc_id", "source", "text")
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
           for r in mixing.op2_query(documents).collect()]
    plan, copies = brute.targets(rows), brute.mix(rows)
    want = [(d, n := len(brute.words(t)), plan[s][0], round(plan[s][1], 6), c * n)
            for (d, s, t), c in zip(rows, copies)]
    same(got, want)


def test_op3_pack(documents):
    rows = rows_of(documents, "doc_id", "text")
    got = packing.op3_query(documents).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], brute.pieces(rows))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= 1 + 1.02 * -(-total // 2048)


def test_op4_shards(documents):
    import zlib
    rows = rows_of(documents, "doc_id", "text")
    got = sharding.op4_query(documents).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got],
         [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows])
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and 0 <= r.shard < 24 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_op5_quality(documents):
    rows = rows_of(documents, "doc_id", "lang", "text")
    got = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept)
           for r in quality.op5_query(documents).collect()]
    same(got, [(d, *v) for (d, _, _), v in zip(rows, brute.quality_verdicts(rows))])


@pytest.mark.parametrize("copies", [False, True])
def test_op5_junk_does_not_set_the_reference(spark, sample_table, tmp_path, copies):
    """A third of a language's documents, and a label of its own or none, change no verdict on clean documents."""
    clean = rows_of(sample_table, "doc_id", "lang", "text")
    rng = random.Random(5)
    stock = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(900)]
    n = sum(la == "en" for _, la, _ in clean) // 2
    lists = [" ".join(rng.choice(stock) for _ in range(400 if copies else rng.randint(250, 600))) for _ in range(n)]
    junk = [(10_000 + i, "en" if i >= 12 else ("zz" if i % 2 else None), lists[0] if copies else t)
            for i, t in enumerate(lists)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(clean + junk, "doc_id long, lang string, text string").write.parquet(path)
    kept = {r.doc_id: r.kept for r in quality.op5_query(spark.read.parquet(path)).collect()}
    alone = {r.doc_id: r.kept for r in quality.op5_query(sample_table).collect()}
    assert not any(kept[d] for d, _, _ in junk)
    assert sum(kept[d] != alone[d] for d in alone) <= len(alone) // 50 and all(kept[d] for d in alone if alone[d])


def test_op9_short_lines(spark):
    docs = spark.createDataFrame([(1, "ab\n \nMenu\nab"), (2, " \nMenu\nMenus\n\n"), (3, None)],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in lines.op9_query(docs).collect()}
    assert got == {1: (4, "3"), 2: (5, "1"), 3: (0, "")}


def test_op6_repeats(documents):
    same([tuple(r) for r in repeats.op6_query(documents).collect()],
         brute.repeats(rows_of(documents, "doc_id", "text")))


def test_op9_lines(documents):
    rows = rows_of(documents, "doc_id", "text")
    got = [(r.doc_id, r.n_lines, r.n_removed, r.removed_lines) for r in lines.op9_query(documents).collect()]
    want = [(d, 0 if t is None else t.count("\n") + 1, len(x), ",".join(map(str, x)))
            for (d, t), x in zip(rows, brute.removed_lines(rows))]
    same(got, want)


def test_op10_licenses(documents):
    rows = rows_of(documents, "doc_id", "text")
    same([tuple(r) for r in licenses.op10_query(documents).collect()],
         [(d, *brute.license_row(t)) for d, t in rows])


@pytest.mark.parametrize("keep", [quality.keep_clean, lines.drop_repeated_lines, ngram_join.keep_one_per_group,
                                  mixing.repeat_by_mix])
def test_filters_keep_the_columns(edge_table, keep):
    out = keep(edge_table)
    assert out.columns == edge_table.columns and out.dtypes == edge_table.dtypes
    assert keep(edge_table.limit(0)).count() == 0


def test_keep_clean_rows(edge_table):
    rows = rows_of(edge_table, "doc_id", "lang", "text")
    want = [r for r, v in zip(rows, brute.quality_verdicts(rows)) if v[2]]
    same(rows_of(quality.keep_clean(edge_table), "doc_id", "lang", "text"), want)


def test_drop_repeated_lines_rows(edge_table):
    rows = rows_of(edge_table, "doc_id", "text")
    want = []
    for (d, t), gone in zip(rows, brute.removed_lines(rows)):
        left = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or brute.WORD.search(left):
            want.append((d, left))
    same(rows_of(lines.drop_repeated_lines(edge_table), "doc_id", "text"), want)


def test_one_row_of_each_group_stays(edge_table):
    rows = rows_of(edge_table, "doc_id", "text", "row")
    root = brute.groups([t for _, t, _ in rows])
    best = {}
    for (d, _, i), r in zip(rows, root):
        key = (d is None, d or 0, i)
        if r is not None and (r not in best or key < best[r]):
            best[r] = key
    want = [d for (d, _, i), r in zip(rows, root) if r is None or best[r] == (d is None, d or 0, i)]
    same(rows_of(ngram_join.keep_one_per_group(edge_table), "doc_id"), [(d,) for d in want])


def test_mix_repeats_rows(edge_table):
    rows = rows_of(edge_table, "doc_id", "source", "text")
    want = [r for r, c in zip(rows, brute.mix(rows)) for _ in range(c)]
    same(rows_of(mixing.repeat_by_mix(edge_table), "doc_id", "source", "text"), want)
