"""N-gram Jaccard self-join by prefixes under several global token orders.

Two documents link when their sets of word shingles have a Jaccard similarity of 75 % or
more.  Then, under any order of all tokens, they share a token among the first
``n - ceil(0.75 n) + 1`` of the larger and of the smaller set, and this holds under several
orders at once: a pair is verified only if it passes under every one.

* Tokens that only one document has cannot be shared.  Documents are packed, without a
  shuffle, into chunks; each chunk reports its distinct tokens with counts, and learns which
  of them other documents have too, and how many.  A document whose shared tokens are fewer
  than 75 % of its set links with nothing and goes no further, so neither unique texts nor
  texts that merely quote a common passage make candidates.
* Of the shared tokens the orders put rare ones first; among tokens of about one frequency
  each order has its own permutation.  The first order is an inverted index: prefix tokens
  are dealt by hash into packed lists, and documents in one list that fit in size are
  candidates.  The further orders filter the candidates where their sets meet, before exact
  verification (words and shingles are compared as 64-bit hashes).
* Documents with equal sets form a class by fingerprint and are compared once per chunk.
* A frequent token's list is dealt to several tasks by document; the shares keep the list's name.
* A long list is not expanded into its pairs.  Neighbours by size are verified first; after
  components are known, only pairs that cross them remain, and of those only the ones with
  a member outside the list's main component.  They are verified block by block, where the
  product of two incidence matrices gives all overlaps, so no pair becomes a row unless it
  is a link.  Every pair of every list is so either verified or inside one component.

Edge cases: null, empty or blank texts have no shingles and link with nothing; shorter
texts than a shingle are one shingle as a whole; rows with one id count as one document for
links; a null id counts as the largest id and comes out null; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import connected
from .shared import bucketed_table, cut, discard, planned_bytes, release, row_key, scratch_scope, scratch_table, shuffle_partitions, small_batches, unpacked, with_key
from .shingles import mix, shingle_sets
from .suffixes import CHUNK_BYTES, NO_ID, _batch, _each, _parts_of, chunk_table

PERCENT = 75
ORDERS = 3
SHORT_LIST = 8
#: Tokens of this level (2 ** 14 documents) or above have their lists dealt by document, too.
HOT_LEVEL = 56
#: Documents of a block in comparisons of long lists.
BLOCK = 64

REQUESTS = "chunk long, part int, low binary, high binary, counts binary"
ANSWERS = "chunk long, part int, mask binary, levels binary"
DOCS = "doc long, k1 long, k2 int, n int, f1 long, f2 long, tokens binary, levels binary"
ENTRIES = "bucket int, sub int, tokens binary, docs binary, sizes binary"
LISTS = "docs binary, sizes binary, name long"
MEMBERS = "list long, doc long, n int"
PAIRS = "a long, b long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(_signed(mix(s, 11).sum(keepdims=True))[0]), int(_signed(np.bitwise_xor.reduce(mix(s, 12), keepdims=True))[0])


def _needed(n: int) -> int:
    """The least overlap of a set of ``n`` with any set similar to it."""
    return -(-PERCENT * n // 100)


def _chunk_sets(row: dict, width: int) -> tuple[list[np.ndarray], list[tuple[int, int]], list[bool]]:
    """Sets of a chunk's documents, their fingerprints, and whether each is the first with its set."""
    lens = np.frombuffer(row["lens"], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(row["blob"])).cast(pa.string())
    sets = shingle_sets(texts, width)
    prints = [_prints(s) if len(s) else (0, 0) for s in sets]
    seen: set = set()
    first = []
    for s, p in zip(sets, prints, strict=True):
        name = (p, len(s))
        first.append(len(s) > 0 and name not in seen)
        seen.add(name)
    return sets, prints, first


def _tokens(sets: list[np.ndarray], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    own = [s for s, f in zip(sets, first, strict=True) if f]
    return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ask(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            sets, _, first = _chunk_sets(row, width)
            u, counts = _tokens(sets, first)
            at = _parts_of(u, parts)
            full = [k for k in range(parts) if at[k] < at[k + 1]]
            if full:
                # 40 bits of a token besides its part: a rare collision only makes a token look shared.
                low, high, counts = u.astype(np.uint32), (u >> np.uint64(32)).astype(np.uint8), np.minimum(counts, 255).astype(np.uint8)
                cuts = [slice(at[k], at[k + 1]) for k in full]
                yield _batch(REQUESTS, [row["chunk"]] * len(full), full, [low[c].tobytes() for c in cuts], [high[c].tobytes() for c in cuts], [counts[c].tobytes() for c in cuts])

    return run


def _answer(table: pa.Table) -> pa.Table:
    low, high, counts = ([np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c] for name, kind in (("low", np.uint32), ("high", np.uint8), ("counts", np.uint8)))
    tokens = np.concatenate(low).astype(np.uint64) | np.concatenate(high).astype(np.uint64) << np.uint64(32)
    order = np.argsort(tokens)
    t = tokens[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(new))
    df = np.empty(len(t), np.int64)
    df[order] = total[np.cumsum(new) - 1]
    shared = df > 1
    level = np.minimum(255, 4 * np.log2(df)).astype(np.uint8)
    out: tuple[list, list, list, list] = ([], [], [], [])
    part, end = table.column("part")[0].as_py(), 0
    for chunk, x in zip(table.column("chunk").to_pylist(), low, strict=True):
        own = slice(end, end + len(x))
        end += len(x)
        if shared[own].any():
            for c, v in zip(out, (chunk, part, np.packbits(shared[own]).tobytes(), level[own][shared[own]].tobytes()), strict=True):
                c.append(v)
    return pa.Table.from_batches([_batch(ANSWERS, *out)])


def _candidates(width: int, parts: int):
    """All documents; those that may link come with their shared tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            sets, prints, first = _chunk_sets(row, width)
            ids = np.frombuffer(row["ids"], np.int64).tolist()
            keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2).tolist()
            u, _ = _tokens(sets, first)
            at = _parts_of(u, parts)
            level = np.zeros(len(u), np.uint8)
            shared = np.zeros(len(u), bool)
            for answer in row["answers"] or []:
                own = slice(at[answer["part"]], at[answer["part"] + 1])
                shared[own] = np.unpackbits(np.frombuffer(answer["mask"], np.uint8), count=own.stop - own.start).astype(bool)
                level[own][shared[own]] = np.frombuffer(answer["levels"], np.uint8)
            tokens, levels = [], []
            for s, f in zip(sets, first, strict=True):
                where = np.searchsorted(u, s) if f else None
                hit = shared[where] if f else None
                may = f and int(hit.sum()) >= _needed(len(s))
                tokens.append(s[hit].tobytes() if may else None)
                levels.append(level[where[hit]].tobytes() if may else None)
            yield _batch(DOCS, ids, [k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], tokens, levels)

    return run


def _places(tokens: np.ndarray, levels: np.ndarray, n: int, order: int) -> np.ndarray:
    """Where the shared tokens of a set of ``n`` are that an order puts first, as many as the similarity demands."""
    p = len(tokens) - _needed(n) + 1
    key = (np.minimum(levels, 63).astype(np.uint64) << np.uint64(58)) | (mix(tokens, 20 + order) >> np.uint64(6))
    return np.arange(len(tokens)) if p >= len(tokens) else np.argpartition(key, p - 1)[:p]


def prefix(tokens: np.ndarray, levels: np.ndarray, n: int, order: int) -> np.ndarray:
    return tokens[_places(tokens, levels, n, order)]


def _index(buckets: int, hot_level: int, flush: int = 1 << 18):
    """Entries of the first order's index by bucket of tokens; those of frequent tokens also by ``sub``, a share of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, levels, docs, sizes = 0, [], [], [], []

        def out() -> pa.RecordBatch:
            n = [len(x) for x in tokens]
            t, v, d, s = np.concatenate(tokens), np.concatenate(levels).astype(np.int64), np.repeat(np.array(docs, np.int64), n), np.repeat(np.array(sizes, np.int32), n)
            shares = np.left_shift(np.int64(1), np.clip((v - hot_level) // 4 + 1, 0, 40))
            sub = np.where(v >= hot_level, (mix(d.view(np.uint64), 41) >> np.uint64(20)).astype(np.int64) % shares % (1 << 30), -1)
            rows: tuple[list, ...] = ([], [], [], [], [])
            order = np.lexsort((t, sub))
            edges = np.flatnonzero(np.concatenate([[True], np.diff(sub[order]) != 0, [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[a:b]
                at = _parts_of(t[own], buckets)
                for k in range(buckets):
                    if at[k] < at[k + 1]:
                        c = own[at[k] : at[k + 1]]
                        for col, x in zip(rows, (k, int(sub[own[0]]), t[c].tobytes(), d[c].tobytes(), s[c].tobytes()), strict=True):
                            col.append(x)
            return _batch(ENTRIES, *rows)

        for batch in batches:
            for doc, n, t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                all_tokens, all_levels = np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint8)
                p = _places(all_tokens, all_levels, n, 0)
                tokens.append(all_tokens[p])
                levels.append(all_levels[p])
                docs.append(doc)
                sizes.append(n)
                held += len(p)
                if held >= flush:
                    yield out()
                    held, tokens, levels, docs, sizes = 0, [], [], [], []
                    release()
        if tokens:
            yield out()

    return run


def _lists(table: pa.Table) -> pa.Table:
    """The distinct lists of two or more documents, each sorted by size and id.

    Lists of a frequent token are shares of one list; they carry its name, and are kept if
    they hold a single document.
    """
    t, d, s = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c]) for name, kind in (("tokens", np.uint64), ("docs", np.int64), ("sizes", np.int32)))
    hot = table.column("sub")[0].as_py() >= 0
    order = np.lexsort((d, s, t))
    t, d, s = t[order], d[order], s[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
    t, d, s = t[new], d[new], s[new]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    ends = np.append(starts[1:], len(t))
    use = ends - starts > (0 if hot else 1)
    names = _signed(t[starts]) if hot else np.zeros(len(starts), np.int64)
    found = {(d[a:b].tobytes(), name): s[a:b].tobytes() for a, b, name in zip(starts[use].tolist(), ends[use].tolist(), names[use].tolist(), strict=True)}
    return pa.Table.from_batches([_batch(LISTS, [x for x, _ in found], list(found.values()), [name if hot else None for _, name in found])])


def _fit(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return 100 * small.astype(np.int64) >= PERCENT * large.astype(np.int64)


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of short lists; neighbours, and neighbours but one, of long lists."""
    upper = {m: np.triu_indices(m, 1) for m in range(2, SHORT_LIST + 1)}
    for batch in batches:
        left, right = [], []
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            d, s = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int32)
            if len(d) < 2:
                continue
            if len(d) <= SHORT_LIST:
                i, j = upper[len(d)]
            else:
                k = np.arange(len(d))
                i, j = np.concatenate([k[:-1], k[:-2]]), np.concatenate([k[1:], k[2:]])
            ok = _fit(s[i], s[j]) & (d[i] != d[j])
            left.append(d[i][ok])
            right.append(d[j][ok])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _long_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the lists whose pairs were not all formed."""
    for batch in batches:
        for x, y, given in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            d = np.frombuffer(x.as_buffer(), np.int64)
            if given is not None or len(d) > SHORT_LIST:
                name = given if given is not None else int(_signed(mix(d.view(np.uint64) + np.arange(len(d), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True))[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), name)), pa.array(d), pa.array(np.frombuffer(y.as_buffer(), np.int32))], names=["list", "doc", "n"])


def similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether sets of ``n_a`` and ``n_b`` tokens are similar, given all those that they may share."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple[int, int], tuple] = {}

        def read(side: dict, known: dict = known) -> tuple:
            name = (side["doc"], len(side["tokens"]))
            if name not in known:
                t, v = np.frombuffer(side["tokens"], np.uint64), np.frombuffer(side["levels"], np.uint8)
                known[name] = (t, side["n"], [np.sort(prefix(t, v, side["n"], k)) for k in range(1, ORDERS)])
            return known[name]

        left, right = [], []
        for i in range(batch.num_rows):
            a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            (s, n, p), (t, m, q) = read(a), read(b)
            if all(len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(p, q, strict=True)) and similar(s, t, n, m):
                left.append(a["doc"])
                right.append(b["doc"])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        release()


def overlaps(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, by products of incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    known = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(known):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        k = np.minimum(np.searchsorted(known, at), len(known) - 1)
        hit = known[k] == at
        order = np.argsort(k[hit], kind="stable")
        return rows[hit][order], k[hit][order]

    sides = [places(a), places(b)]
    for lo in range(0, len(known), step):
        parts = []
        for (rows, k), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(k, [lo, lo + step])
            m = np.zeros((n, min(step, len(known) - lo)), np.float32)
            m[rows[i:j], k[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between documents of two blocks that are in different components."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            both = overlaps(*[[np.frombuffer(d["tokens"], np.uint64) for d in side] for side in (left, right)])
            n, m = (np.array([d["n"] for d in side], np.int64) for side in (left, right))
            c, e = (np.array([d["comp"] for d in side], np.int64) for side in (left, right))
            near = (100 * both >= PERCENT * (n[:, None] + m[None, :] - both)) & (c[:, None] != e[None, :])
            a, b = (np.array([d["doc"] for d in side], np.int64) for side in (left, right))
            x, y = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], b[y])), pa.array(np.maximum(a[x], b[y]))], names=["a", "b"])
        release()


def join_components(df: DataFrame, width: int = 5, chunk_bytes: int = CHUNK_BYTES, hot_level: int = HOT_LEVEL) -> DataFrame:
    """One row for each row of ``df(doc_id, text)``: doc_id, its content key, n_shingles and component_id.

    The result is written to the checkpoint folder; scratch tables are gone when this returns.
    """
    spark = df.sparkSession
    with scratch_scope() as made, small_batches(spark):
        out = cut(_components(df, width, chunk_bytes, hot_level))
    discard(spark, made)
    return out


def _components(df: DataFrame, width: int, chunk_bytes: int, hot_level: int) -> DataFrame:
    spark = df.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = df.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key(doc_id, F.col("text")))
    n = max(shuffle_partitions(spark), planned_bytes(rows) // (32 << 20))
    buckets = 4 * n
    with scratch_scope() as early:
        chunks = chunk_table(rows, chunk_bytes)
        asked = chunks.select("chunk", "lens", "blob").mapInArrow(_ask(width, buckets), REQUESTS)
        answers = scratch_table(asked.groupBy("part").applyInArrow(_answer, ANSWERS), "answers")
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "mask", "levels")).alias("answers"))
    docs = bucketed_table(chunks.join(told, "chunk", "left").mapInArrow(_candidates(width, buckets), DOCS), "sets", "doc", n)
    discard(spark, early)
    # A class of equal sets goes by its smallest id, ``low``; one member that has its tokens at hand, ``rep``, stands for it.
    classes = cut(docs.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc").alias("low"), F.min(F.when(F.col("tokens").isNotNull(), F.col("doc"))).alias("rep")))
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc"))
    sets = docs.where("tokens is not null").join(reps, "doc", "left_semi")

    entries = sets.select("doc", "n", "tokens", "levels").mapInArrow(_index(buckets, hot_level), ENTRIES)
    lists = scratch_table(entries.groupBy("bucket", "sub").applyInArrow(_lists, LISTS).distinct(), "lists")
    pairs = cut(lists.mapInArrow(_first_pairs, PAIRS).distinct())
    members = cut(lists.mapInArrow(_long_lists, MEMBERS))

    def verify(pairs: DataFrame) -> DataFrame:
        side = F.struct("doc", "n", "tokens", "levels")
        one = pairs.join(sets.select(F.col("doc").alias("a"), side.alias("left")), "a")
        two = one.join(sets.select(F.col("doc").alias("b"), side.alias("right")), "b")
        return cut(two.select("left", "right").mapInArrow(_verify, PAIRS).distinct())

    lows = classes.where("rep is not null").select("rep", "low")

    def named(links: DataFrame) -> DataFrame:
        """Links of representatives as links of their classes."""
        at = lambda side: lows.select(F.col("rep").alias(side), F.col("low").alias(f"{side}_low"))
        return links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))

    links = named(verify(pairs))
    labels = connected(links)

    # What long lists leave open: pairs that cross components.
    where = lows.join(labels, lows["low"] == labels["node"], "left").select("rep", F.coalesce("component", "low").alias("comp"))
    placed = cut(members.join(where, members["doc"] == where["rep"]).select("list", "doc", "n", "comp"))
    sizes = placed.groupBy("list", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("list").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    # Lists with one main component have mostly the same members; their pairs are formed once.
    open_ = cut(_salted(placed, main, "list").select("main", "doc", "n", "comp").distinct())
    if not open_.isEmpty():
        # They are compared block by block: a block of all members with one of those outside the main component.
        many = open_.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = _salted(open_, many, "main").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")).join(sets.select("doc", "tokens"), "doc")
        pack = F.collect_list(F.struct("doc", "n", "comp", "tokens"))
        # One family's comparisons are spread over as many tasks as it has sixteens of blocks.
        tasks = F.ceil(F.col("blocks") / 16)
        every = dealt.groupBy("main", "block", "blocks").agg(pack.alias("members")).withColumn("task", F.pmod("block", tasks))
        outside = dealt.where("comp <> main").groupBy("main", F.floor(F.col("block") / 4).alias("block"), "blocks").agg(pack.alias("outside"))
        outside = outside.withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)))
        late = cut(every.select("main", "task", "members").join(outside.select("main", "task", "outside"), ["main", "task"]).select("members", "outside").mapInArrow(_verify_blocks, PAIRS).distinct())
        if not late.isEmpty():
            labels = connected(links.unionByName(named(late)))
    null_id = lambda c: F.when(c != NO_ID, c)
    ends = classes.join(labels, classes["low"] == labels["node"], "left").select("f1", "f2", "n", F.coalesce("component", "low").alias("end"))
    return docs.select("doc", "k1", "k2", "n", "f1", "f2").join(ends, ["f1", "f2", "n"], "left").select(
        null_id(F.col("doc")).alias("doc_id"),
        F.col("k1").alias("_k1"),
        F.col("k2").alias("_k2"),
        F.col("n").cast("long").alias("n_shingles"),
        null_id(F.coalesce("end", "doc")).alias("component_id"),
    )


def _salted(many: DataFrame, one: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join of ``many(key, doc, ...)`` with at most one row of ``one`` for each key; a key's rows are dealt to several tasks."""
    return many.withColumn("_s", F.pmod(F.xxhash64("doc"), F.lit(salts))).join(one.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "_s"]).drop("_s")


def keep_one(df: DataFrame, width: int = 5) -> DataFrame:
    """One row of each component of ``df``: a row of its smallest id, with all columns; rows without shingles stay, and of repeated rows one."""
    found = join_components(df, width)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("_k1", "_k2").distinct()
    first = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0)))
    return unpacked(with_key(df, "doc_id", "text").join(stay, ["_k1", "_k2"], "left_semi").withColumn("_nth", first).where("_nth = 1"), df.columns)
