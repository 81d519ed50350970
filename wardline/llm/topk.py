"""Exact top-k by inner product: columnar branch and bound in blocks.

Vectors become integers (``floor(scale * x)``) and are packed into blocks in a
vertical layout, one run of values for each dimension.  Query vectors are the
stated rows, gathered into full blocks.  Every query block first meets one
block of candidates; the k-th best score a query finds there is a score that
its answers must reach, and goes with it.  Then blocks of queries meet all
blocks of candidates.  For such a pair the scores are accumulated dimension
block by dimension block, dimensions of largest mass first.  What the open
dimensions can still add is at most the product of the two remaining norms
(Cauchy-Schwarz), so a candidate whose partial score plus this bound stays
below what a query needs is dropped for that query.  Columns that no query
needs are compacted away; once few pairs are left, only these go on.  Each
pair of blocks gives at most k rows for each query and these are ranked.

Scores are exact: sums of products below 2^53 run in float64 matrix products,
larger components in Python integers.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part; vectors of different lengths are compared as if the
shorter one went on with zeros; rows with the same id are rows of their own,
and only the query's own row is left out; a null id sorts last among ties and
is no query; fewer candidates than k give fewer rows; a score outside the
range of a long counts as that range's nearest end; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch, clean_columns

SCALE = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 256
DIM_BLOCK = 8
FEW_PAIRS = 0.25    # share of open pairs below which they go on one by one
_LONG = (-(1 << 63), (1 << 63) - 1)
_NO_ID = np.iinfo(np.int64).max


def quantised(vector: list | None, scale: int) -> list[int] | None:
    """floor(scale * x) of each component in double arithmetic; None if a component is null or not finite."""
    if vector is None or any(x is None for x in vector):
        return None
    wide = np.asarray(vector, dtype=np.float64) * scale
    if not np.isfinite(wide).all():
        return None
    return [int(x) for x in np.floor(wide)]


def _rows_of(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list, np.ndarray | None]:
    """Kept row numbers, and their integer vectors as one matrix or, if they don't fit one, as lists."""
    col = batch.column("embedding").cast(pa.list_(pa.float64()))
    n = len(col)
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values
    lengths = np.diff(off)
    values = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(over="ignore"):
        values = values * scale
    ok = ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok &= (broken[off[1:]] - broken[off[:-1]]) == 0
    rows = np.flatnonzero(ok)
    if not len(rows):
        return rows, [], None
    dims = int(lengths[rows].max())
    floors = np.floor(values)
    if np.all(lengths[rows] == dims) and (not len(floors) or np.nanmax(np.abs(np.where(np.isfinite(floors), floors, 0)))
                                          < 2 ** 53):
        m = np.empty((len(rows), dims))
        for j, r in enumerate(rows.tolist()):
            m[j] = floors[off[r]:off[r + 1]]
        return rows, [], m
    return rows, [[int(x) for x in floors[off[r]:off[r + 1]]] for r in rows.tolist()], None


_DTYPES = {0: "<f8", 2: "<i2", 4: "<i4"}  # how a block's values are stored; 1: as text


def _encode(matrix: np.ndarray) -> tuple[int, bytes]:
    """Storage kind and bytes of a dims x rows matrix, all values of a dimension side by side."""
    if matrix.dtype == object:
        return 1, repr([[int(x) for x in column] for column in matrix]).encode()
    top = np.abs(matrix).max() if matrix.size else 0
    kind = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 0
    return kind, np.ascontiguousarray(matrix).astype(_DTYPES[kind]).tobytes()


def _unpack(n_rows: int, dims: int, kind: int, packed: bytes) -> np.ndarray:
    """dims x rows values: float64, or Python integers if they are huge."""
    if kind == 1:
        import ast
        return np.array(ast.literal_eval(packed.decode()), dtype=object).reshape(dims, n_rows)
    return np.frombuffer(packed, dtype=_DTYPES[kind]).reshape(dims, n_rows).astype(np.float64)


def _pack(scale: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                part = batch.slice(a, block_rows)
                rows, lists, matrix = _rows_of(part, scale)
                if not len(rows):
                    continue
                if matrix is None:  # ragged or huge: zero-padded integers
                    dims = max(map(len, lists), default=0)
                    padded = [v + [0] * (dims - len(v)) for v in lists]
                    huge = any(abs(x) >= 2 ** 53 for v in lists for x in v)
                    matrix = np.array(padded, dtype=object if huge else np.float64).reshape(len(rows), dims)
                kind, packed = _encode(matrix.T)
                ids = part.column("vec_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([matrix.shape[1]], pa.int32()),
                     pa.array([kind], pa.int32()), pa.array([packed], pa.binary())],
                    names=["ids", "dims", "kind", "packed"])
    return run


BLOCK = "ids array<bigint>, dims int, kind int, packed binary"


def _pad(m: np.ndarray, dims: int) -> np.ndarray:
    if m.shape[0] == dims:
        return m
    return np.concatenate([m, np.zeros((dims - m.shape[0], m.shape[1]), dtype=m.dtype)])


def block_top(queries: np.ndarray, cands: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int,
              least: list | None = None, dim_block: int = DIM_BLOCK,
              trace: list | None = None) -> list[list[tuple[int, int, int]]]:
    """For each query column the best (score, id, column) of the candidate columns, at most k.

    ``own`` holds the query's own column or -1; candidates below a query's ``least`` may be left out.  Ties
    go to the smaller id.  ``trace`` receives the number of open pairs after each block of dimensions.
    """
    dims = max(queries.shape[0], cands.shape[0])
    queries, cands = _pad(queries, dims), _pad(cands, dims)
    n_q, n_c = queries.shape[1], cands.shape[1]
    largest = lambda m: max((abs(int(x)) for x in (m.min(), m.max())), default=0) if m.size else 0
    if queries.dtype == object or cands.dtype == object or largest(queries) * largest(cands) * max(dims, 1) >= 2 ** 52:
        to_int = np.vectorize(int, otypes=[object])
        q, c = to_int(queries) if queries.size else queries, to_int(cands) if cands.size else cands
        scores = q.T.dot(c) if dims else np.zeros((n_q, n_c), dtype=object)
        return [_best(list(scores[i]), ids, np.arange(n_c), own[i], k) for i in range(n_q)]

    order = np.argsort(-((queries ** 2).sum(axis=1) * (cands ** 2).sum(axis=1)), kind="stable")
    queries, live = queries[order], cands[order]
    # what the dimensions behind each one can add, as norms
    q_rest = np.sqrt(np.cumsum((queries ** 2)[::-1], axis=0)[::-1])
    c_rest = np.sqrt(np.cumsum((live ** 2)[::-1], axis=0)[::-1])
    need = np.array([-np.inf if x is None else x for x in (least or [None] * n_q)], dtype=float)
    alive, scores, pairs = np.arange(n_c), np.zeros((n_q, n_c)), None
    not_own = np.ones((n_q, n_c), dtype=bool)
    not_own[np.flatnonzero(own >= 0), own[own >= 0]] = False
    for d in range(0, dims, dim_block):
        nxt = min(d + dim_block, dims)
        if pairs is None:
            scores += queries[d:nxt].T @ live[d:nxt]
        else:
            scores += (queries[d:nxt, pairs[0]] * live[d:nxt, pairs[1]]).sum(axis=0)
        if nxt < dims and pairs is None:
            # rounding of the bound is within its own 1e-12th part and 2
            bound = q_rest[nxt][:, None] * c_rest[nxt][alive][None, :] * (1 + 1e-12) + 2
            if len(alive) > k:
                sure = np.where(not_own, scores - bound, -np.inf)
                need = np.maximum(need, np.partition(sure, len(alive) - k, axis=1)[:, len(alive) - k])
            keep = not_own & (scores + bound >= need[:, None])
            if keep.mean() < FEW_PAIRS:
                pairs = np.nonzero(keep)
                scores = scores[pairs]
            else:
                columns = keep.any(axis=0)
                if columns.sum() < 0.8 * len(alive):
                    alive, scores, live, not_own = alive[columns], scores[:, columns], live[:, columns], not_own[:, columns]
        elif nxt < dims:
            bound = q_rest[nxt][pairs[0]] * c_rest[nxt][alive[pairs[1]]] * (1 + 1e-12) + 2
            keep = scores + bound >= need[pairs[0]]
            pairs, scores = (pairs[0][keep], pairs[1][keep]), scores[keep]
        if trace is not None:
            trace.append(len(scores) if pairs else int(keep.sum()) if nxt < dims else scores.size)
    if pairs is None:
        pairs = np.nonzero(not_own & (scores >= need[:, None]))
        scores = scores[pairs]
    cut = np.searchsorted(pairs[0], np.arange(n_q + 1))
    out = []
    for i in range(n_q):
        row, columns = scores[cut[i]:cut[i + 1]], alive[pairs[1][cut[i]:cut[i + 1]]]
        if len(row) > k:
            near = row >= np.partition(row, len(row) - k)[len(row) - k]
            row, columns = row[near], columns[near]
        out.append(_best([int(x) for x in row], ids, columns, own[i], k))
    return out


def _best(scores: list, ids: np.ndarray, columns: np.ndarray, own: int, k: int) -> list[tuple[int, int, int]]:
    low, high = _LONG
    found = [(min(max(int(s), low), high), int(ids[c]), int(c)) for s, c in zip(scores, columns) if c != own]
    found.sort(key=lambda x: (-x[0], x[1]))
    return found[:k]


QUERIES = ("q_set long, q_blocks array<bigint>, q_rows array<int>, q_ids array<bigint>, q_dims int, q_kind int, "
           "q_packed binary")


def _met(r: dict, k: int) -> list[list[tuple[int, int, int]]]:
    """Best candidates of a row that holds a block of queries and one of candidates."""
    ids = np.array([_NO_ID if x is None else x for x in r["ids"]], dtype=np.int64)
    cands = _unpack(len(r["ids"]), r["dims"], r["kind"], r["packed"])
    queries = _unpack(len(r["q_ids"]), r["q_dims"], r["q_kind"], r["q_packed"])
    own = np.array([row if block == r["block"] else -1 for block, row in zip(r["q_blocks"], r["q_rows"])], dtype=np.int64)
    return block_top(queries, cands, ids, own, k, r.get("least"))


def _first_scores(k: int):
    """The k-th best score of each query of a block (null: fewer candidates)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                least = [found[k - 1][0] if len(found) == k else None for found in _met(r, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["q_set"]], pa.int64()), pa.array([least], pa.list_(pa.int64()))],
                    names=["q_set", "least"])
    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(q, block, at, s, i, r["block"], c)
                        for q, block, at, found in zip(r["q_ids"], r["q_blocks"], r["q_rows"], _met(r, k))
                        for s, i, c in found]
                if not rows:
                    continue
                q, block, at, s, i, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(block, pa.int64()), pa.array(at, pa.int32()),
                     pa.array(s, pa.int64()),
                     pa.array([None if x == _NO_ID and r["ids"][y] is None else x for x, y in zip(i, c)], pa.int64()),
                     pa.array(b, pa.int64()), pa.array(c, pa.int32())],
                    names=["query_id", "q_block", "q_row", "score", "vec_id", "block", "col"])
    return run


def _take_queries(divisor: int):
    """The query rows of each candidate block, one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [j for j, x in enumerate(r["ids"]) if x is not None and x % divisor == 0]
                values = _unpack(len(r["ids"]), r["dims"], r["kind"], r["packed"])
                packed = [_encode(values[:, [j]]) for j in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * len(rows), pa.int64()), pa.array(rows, pa.int32()),
                     pa.array([r["ids"][j] for j in rows], pa.int64()), pa.array([r["dims"]] * len(rows), pa.int32()),
                     pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary())],
                    names=["q_block", "q_row", "q_id", "dims", "kind", "packed"])
    return run


def _gather(query_rows: int):
    """Blocks of at most ``query_rows`` single queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, query_rows):
                rows = batch.slice(a, query_rows).to_pylist()
                dims = max(r["dims"] for r in rows)
                values = np.concatenate([_pad(_unpack(1, r["dims"], r["kind"], r["packed"]), dims) for r in rows], axis=1)
                kind, packed = _encode(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[r["q_block"] for r in rows]], pa.list_(pa.int64())),
                     pa.array([[r["q_row"] for r in rows]], pa.list_(pa.int32())),
                     pa.array([[r["q_id"] for r in rows]], pa.list_(pa.int64())), pa.array([dims], pa.int32()),
                     pa.array([kind], pa.int32()), pa.array([packed], pa.binary())],
                    names=["q_blocks", "q_rows", "q_ids", "q_dims", "q_kind", "q_packed"])
    return run


def top_k(vectors: DataFrame, k: int = 5, *, query_divisor: int = 50, scale: int = SCALE,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``query_divisor`` divides, against all rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = clean_columns(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    blocks = scratch.write(vectors.mapInArrow(_pack(scale, block_rows), BLOCK)
                           .withColumn("block", F.monotonically_increasing_id()), "blocks")
    single = scratch.write(blocks.mapInArrow(
        _take_queries(query_divisor), "q_block long, q_row int, q_id long, dims int, kind int, packed binary"), "single")
    # a part holds a few blocks of queries, so that most blocks are full
    n_parts = 1 + single.count() // (4 * query_rows)
    queries = scratch.write(single.repartition(n_parts, "q_block", "q_row")
                            .mapInArrow(_gather(query_rows), QUERIES.removeprefix("q_set long, "))
                            .withColumn("q_set", F.monotonically_increasing_id())
                            .withColumn("first", F.lit(0)), "queries")
    # one block of candidates, at most block_rows vectors, shows every query a score it must reach
    sample = scratch.write(blocks.orderBy(F.xxhash64("block"), "block").limit(1).withColumn("first", F.lit(0)), "sample")
    reached = scratch.write(queries.join(sample, "first").mapInArrow(_first_scores(k), "q_set long, least array<bigint>"),
                            "reached")
    # every query block meets every candidate block: that is the stated search.  The queries are the
    # smaller side, so each of their blocks is sent to each cell of a grid that holds the candidates.
    n_cells = max(1, blocks.count())
    cell = F.pmod(F.xxhash64("block"), F.lit(n_cells)).cast("int")
    met = (queries.drop("first").join(reached, "q_set")
           .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
           .join(blocks.withColumn("cell", cell), "cell"))
    local = met.mapInArrow(_search(k),
                           "query_id long, q_block long, q_row int, score long, vec_id long, block long, col int")
    best_first = F.struct((-F.col("score")).alias("a"), F.coalesce("vec_id", F.lit(_NO_ID)).alias("b"), "vec_id",
                          "score", "block", "col")
    # at most k rows for each query and candidate block
    order = Window.partitionBy("q_block", "q_row").orderBy(F.col("o.a"), F.col("o.b"), F.col("o.block"), F.col("o.col"))
    return (local.withColumn("o", best_first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.rid AS q_rid, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
