"""The pipeline's stages one after the other against the plain Python versions."""

from collections import Counter

import brute

import corpus_pipeline


def test_pipeline_against_brute_force(spark, edge_table, tmp_path):
    folder = tmp_path / "tables"
    edge_table.write.parquet(f"{folder}/documents.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "lang", "source", "text").collect()]

    verdicts = brute.quality_verdicts([(d, la, t) for d, la, _, t in rows])
    rows = [r for r, v in zip(rows, verdicts) if v[2]]
    kept = []
    for (d, la, s, t), gone in zip(rows, brute.removed_lines([(d, t) for d, _, _, t in rows])):
        left = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or brute.WORD.search(left):
            kept.append((d, la, s, left))
    root = brute.groups([t for *_, t in kept])
    first = {}
    for i, r in enumerate(root):
        if r is not None and (r not in first or (kept[i][0] is None, kept[i][0] or 0) < (
                kept[first[r]][0] is None, kept[first[r]][0] or 0)):
            first[r] = i
    kept = [x for i, x in enumerate(kept) if root[i] is None or first[root[i]] == i]
    copies = brute.mix([(d, s, t) for d, _, s, t in kept])
    want = Counter(p for (d, _, _, t), c in zip(kept, copies) for _ in range(c) for p in brute.pieces([(d, t)]))

    got = corpus_pipeline.run(spark, str(folder))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want


def test_stages_return_the_columns_of_documents(spark, edge_table):
    docs = edge_table.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
