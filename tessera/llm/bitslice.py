"""Exact top-k by integer inner product over a bit-sliced index.

Each component x of a vector becomes the whole number floor(256 x).  The index holds the
vectors in blocks, and of each block and component one bitmap for each binary digit (two's
complement): bit r of slice j of component i is digit j of component i of row r.  A query
multiplies slices by its own components' digits and adds them with bitmap arithmetic
(carry-save adders over whole bitmaps), which leaves the score of all rows as slices.  The
best rows are chosen from the most significant slice downwards; rows that tie at the
boundary in every slice are resolved by their smaller id.

The index covers every row.  Queries meet all blocks in blocks of their own, and per query
and block only the k best travel on.

Edge cases: null vectors, vectors with a null or non-finite component and rows with a null
id take no part; a shorter vector counts as padded with zeros; rows with one id count as
one row for leaving out the query's own, and each of them is a candidate for others (query
rows of one id share one list, of the best scores of them all);
scores and components have to fit into 62 bits; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch_table

BLOCKS = "grp int, n int, dims int, digits int, ids binary, slices binary"
QUERIES = "share int, q_ids binary, q_dims int, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def _words(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (last axis: rows) packed into words of 64."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def slice_block(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Bit slices of ``values`` (rows x components): number of digits, array (component, digit, word)."""
    digits = int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length() + 1
    bits = (values.T[:, None, :] >> np.arange(digits)[None, :, None]) & 1
    return digits, _words(bits.astype(np.uint8))


def _signed_digits(q: int) -> list[tuple[int, int]]:
    """q as sum of sign * 2 ** place with few terms (non-adjacent form)."""
    out, place = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((place, d))
            q -= d
        q >>= 1
        place += 1
    return out


def score_slices(slices: np.ndarray, query: list[int]) -> list[np.ndarray]:
    """Slices (two's complement, least significant first) of the inner products of all rows with ``query``.

    A term -2**p * X is 2**p * ~X + 2**p with X's digits inverted, so only additions are
    needed.  All slices of one weight are reduced three at a time by full adders.
    """
    dims, digits, n_words = slices.shape
    bound = sum(abs(q) for q in query) << (digits - 1)
    width = bound.bit_length() + 1
    piles: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
    constant = 0
    inverted = ~slices
    for i, q in enumerate(query[:dims]):
        for place, sign in _signed_digits(q):
            source = slices[i] if sign > 0 else inverted[i]
            if sign < 0:
                constant += 1 << place
            for j in range(digits - 1):
                if place + j < width:
                    piles[place + j].append(source[j])
            # The top digit counts negatively: -2**t * b = 2**t * ~b - 2**t.
            if place + digits - 1 < width:
                piles[place + digits - 1].append((inverted if sign > 0 else slices)[i, digits - 1])
            constant -= 1 << (place + digits - 1)
    ones = np.full(n_words, 2**64 - 1, np.uint64)
    for w in range(width):
        if (constant >> w) & 1:
            piles[w].append(ones)
    out = []
    for w in range(width):
        pile = piles[w]
        up = piles[w + 1]
        while len(pile) >= 3:
            rest = []
            for k in range(0, len(pile) - 2, 3):
                a, b, c = pile[k], pile[k + 1], pile[k + 2]
                ab = a ^ b
                rest.append(ab ^ c)
                up.append((a & b) | (ab & c))
            pile = rest + pile[len(pile) - len(pile) % 3 :]
        if len(pile) == 2:
            up.append(pile[0] & pile[1])
            pile = [pile[0] ^ pile[1]]
        out.append(pile[0] if pile else np.zeros(n_words, np.uint64))
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(scores: list[np.ndarray], candidates: np.ndarray, k: int) -> list[int]:
    """The k best rows of a bitmap of candidates, or all if fewer; ties go to the first rows."""
    sure, open_ = np.zeros_like(candidates), candidates
    n_sure = 0
    for w in range(len(scores) - 1, -1, -1):
        digit = ~scores[w] if w == len(scores) - 1 else scores[w]  # a set sign bit is less
        high = open_ & digit
        n = n_sure + _count(high)
        if n > k:
            open_ = high
        else:
            sure, open_, n_sure = sure | high, open_ & ~digit, n
            if n == k:
                break
    rows = _members(sure)
    return rows + (_members(open_)[: k - len(rows)] if len(rows) < k else [])


def _members(bitmap: np.ndarray) -> list[int]:
    words = np.flatnonzero(bitmap)
    return [64 * w + b for w in words.tolist() for b in range(64) if int(bitmap[w]) >> b & 1]


def _score(scores: list[np.ndarray], row: int) -> int:
    w, b = divmod(row, 64)
    digits = [int(s[w]) >> b & 1 for s in scores]
    return sum(d << i for i, d in enumerate(digits)) - (digits[-1] << len(digits))


def _quantised(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if vec_id is None or not v.is_valid or v.values.null_count:
            continue
        x = np.asarray(v.values, np.float64)
        if np.isfinite(x).all():
            yield vec_id, np.floor(256 * x).astype(np.int64)


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def _build(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            values = _matrix([v for _, v in rows])
            digits, slices = slice_block(values)
            ids = np.array([i for i, _ in rows], np.int64)
            return pa.RecordBatch.from_pydict(
                {"grp": pa.array([0], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "dims": pa.array([values.shape[1]], pa.int32()), "digits": pa.array([digits], pa.int32()), "ids": [ids.tobytes()], "slices": [slices.tobytes()]}
            )

        for batch in batches:
            for row in _quantised(batch):
                rows.append(row)
                if len(rows) >= block_rows:
                    yield block()
                    rows.clear()
        if rows:
            yield block()

    return run


def _query_blocks(per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            values = _matrix([v for _, v in rows])
            return pa.RecordBatch.from_pydict({"share": pa.array([TaskContext.get().partitionId()], pa.int32()), "q_ids": [np.array([i for i, _ in rows], np.int64).tobytes()], "q_dims": pa.array([values.shape[1]], pa.int32()), "vectors": [values.tobytes()]})

        for batch in batches:
            for row in _quantised(batch):
                rows.append(row)
                if len(rows) >= per_block:
                    yield block()
                    rows.clear()
        if rows:
            yield block()

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["digits"], -1)
                all_rows = _words(np.ones(row["n"], np.uint8))
                queries = np.frombuffer(row["vectors"], np.int64).reshape(-1, row["q_dims"])
                out: tuple[list, list, list] = ([], [], [])
                for q_id, query in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), queries.tolist(), strict=True):
                    scores = score_slices(slices, query)
                    candidates = all_rows.copy()
                    own = slice(*np.searchsorted(ids, [q_id, q_id + 1]).tolist())
                    for r in range(own.start, own.stop):
                        candidates[r // 64] &= ~np.uint64(1 << (r % 64))
                    for r in top_rows(scores, candidates, k):
                        for c, v in zip(out, (q_id, int(ids[r]), _score(scores, r)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 1 << 16, queries_per_block: int = 128, tasks: int | None = None) -> DataFrame:
    """The ``k`` best rows of ``vectors(vec_id, embedding)`` for each row of ``queries``, its own id left out.

    Blocks of the index are dealt into groups, and blocks of queries, where there are fewer
    groups than ``tasks``, into shares; a slot joins one group with one share.  So a block of
    queries goes once to each group, and a block of the index once to each share.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n_blocks = max(1, -(-vectors.count() // block_rows))
    index = scratch_table(pick(vectors).repartition(n_blocks).mapInArrow(_build(block_rows), BLOCKS), "slices")
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    n_groups = min(n_blocks, tasks)
    shares = -(-tasks // n_groups)
    slots = n_groups * shares
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = (F.col("grp") * shares + F.col("share")).alias("slot")
    blocks = index.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int")).withColumn("share", every(shares)).select(slot, "n", "dims", "digits", "ids", "slices")
    asked = pick(queries).repartition(shares).mapInArrow(_query_blocks(queries_per_block), QUERIES)
    asked = asked.withColumn("grp", every(n_groups)).select(slot, "q_ids", "q_dims", "vectors")
    # Numbers given to repartition stay as they are; a join of small rows would be put into one task.
    found = blocks.repartition(slots, "slot").join(asked.repartition(slots, "slot").hint("shuffle_merge"), "slot").select("n", "dims", "digits", "ids", "slices", "q_ids", "q_dims", "vectors").mapInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
