import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


NEAR = ("the quick brown fox jumps over the lazy dog while seven small boats drift along the quiet river bank and "
        "nobody watches them go past the old stone bridge where children used to play in the long warm evenings of "
        "summer before the mill closed and the road was moved away from the village to the other side of the hill")
PASSAGE = ("every passage that many documents share should be found even when it stands between other words and does "
           "not begin at the same place in each of them")
LICENSE = "Released under the MIT License."


def edge_documents():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, copies of both kinds."""
    changed = NEAR.replace("lazy", "sleepy")
    rows = [
        (None, None, None, None), (None, NEAR, "en", None), (1, "", "en", "a"), (1, "", "en", "a"),
        (2, " \n\t ", "en", "a"), (3, "a b", "de", "b"), (3, "a b", "de", "b"), (4, "A  B", None, "b"),
        (5, NEAR, "en", "a"), (6, NEAR, "en", "c"), (7, changed, "en", "c"), (7, changed, "en", "c"),
        (8, NEAR.upper(), "en", "d"), (9, "one two three four", "en", "d"), (10, "one two three four", "en", "é"),
        (11, "x" * 20_000, "en", "e"), (12, "ab " * 8_000, "en", "e"),
        (13, f"first own words here {PASSAGE} last own words", "en", "a"),
        (14, f"{PASSAGE} and then some more text of its own", "en", "b"),
        (15, f"quite another beginning, {PASSAGE}", "fr", "b"),
        (16, f"a line\n{LICENSE}\n{LICENSE}\nanother line", "en", "b"),
        (17, "Licensed under the Apache Licence, Version 2.0 or so\nthe rest", "en", "c"),
        (18, "this line is long enough to be judged alone\nand this one is also long enough for it", "en", "c"),
        (19, "this line is long enough to be judgd alone\nand a third one that nobody else has got", "en", "c"),
        (20, "this line is long enough to be judgd  alone\r\n\n\nend", "en", "c"),
        (21, "größere Wörter über naïve façades 中文 \U0001F600 " * 20, "de", "d"),
        (22, "### $$$ %%% &&& *** ||| <<< >>> " * 30, "en", "d"),
        (23, "<|endoftext|> Don't <|ENDOFTEXT|> we'll 1234 é É", "en", "d"),
        (24, " ".join(f"word{i}" for i in range(6_000)), "en", "a"),
        (25, " ".join(f"word{i}" for i in range(5_990)), "en", "b"),
        (26, "under the MIT license, cc by-nc and the apache license version 2", "en", "b"),
    ]
    return rows


# columns of the user's own whose names an operator might use inside
CLASHING = ["row", "n", "key", "h", "cls", "lines", "copy", "doc", "_doc", "_row", "place", "size", "line", "kept"]


@pytest.fixture(scope="session")
def edge_table(spark, tmp_path_factory):
    """The edge rows as a written table with extra columns."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[i] * len(CLASHING)) for i, r in enumerate(edge_documents())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} long" for c in CLASHING)
    spark.createDataFrame(rows, schema).select(*columns).coalesce(2).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@pytest.fixture(scope="session")
def sample_table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(params=["edge", "sample", "none"])
def documents(request, edge_table, sample_table):
    """A table of documents: the edge cases, the smallest test table, or no rows at all."""
    return {"edge": edge_table, "sample": sample_table, "none": edge_table.limit(0)}[request.param]
