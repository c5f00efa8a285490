"""Exact removal of repeated byte strings by sorting sampled suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with
a smaller id.  A full suffix array of the corpus would move every suffix; here only those
suffixes are sorted that can decide anything:

1. Documents are packed, without a shuffle, into chunks of some hundred kilobytes, bucketed by
   chunk number, so that later steps meet them again in place.
2. Every string of LENGTH bytes names one of its ``ANCHOR``-byte substrings: the one with
   the least hash, the leftmost of equals.  Equal strings name the same one, at the same
   place inside.  Each chunk reports the distinct hashes of its anchors, and learns which
   of them other chunks have too.  An anchor of one document alone decides nothing.
3. The suffixes that start at shared anchors, with the bytes before them, are
   range-partitioned by their leading bytes.  Splitters are quantiles of a sample of shared
   anchors, weighted by the chunks that have them; there are the more ranges the more bytes
   there are.  Equal suffixes of a chunk travel once, with the smallest id, so that a
   passage of very many documents does not fill one range.
4. A range is sorted locally by multikey quicksort over words of eight bytes, both forwards
   from the anchor and backwards from it.  Common-prefix lengths of neighbours in either
   order number the classes of equal strings of every length, and a pair of classes
   (backward, forward) is a class of equal strings around the anchor, whose smallest
   document decides.  Ranges are cut between anchors, never inside one, so no class of
   equal strings reaches over a boundary and neighbouring ranges need no comparison.
5. An anchor that very many chunks have (``hot_chunks``) would overfill its range wherever
   splitters fall.  Its strings of LENGTH bytes go instead, each as a whole, to further
   ranges by their own hash, and are sorted and compared there.
6. Verdicts go back to the chunks, which cut the covered bytes.

Nothing is compared by hash alone except in step 2, where a collision only lets a suffix
take part needlessly.

Edge cases: a null text is empty; texts below LENGTH bytes stay; rows with one id count as
one document, so they take nothing from each other; a null id counts as the largest; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed_table, cut, discard, planned_bytes, release, scratch_scope, scratch_table, shuffle_partitions, small_batches

LENGTH, ANCHOR = 50, 20
LEFT = LENGTH - ANCHOR
CONTEXT = LEFT + LENGTH
SLICE = 1 << 18
#: Bytes of text in a chunk.  Rows stay below half a megabyte, which the JVM's collector treats as small.
CHUNK_BYTES = 384 << 10
NO_ID = np.iinfo(np.int64).max

CHUNKS = "chunk long, ids binary, keys binary, lens binary, blob binary, rest binary"
#: Chunks that share an anchor from which on its strings are dealt one by one.
HOT_CHUNKS = 1 << 16
#: One hash in so many is reported with its anchor, as sample for the splitters.
DRAWN = 16

REQUESTS = "chunk long, part int, hashes binary, leads binary"
ANSWERS = "chunk long, part int, mask binary, hot binary, lead binary, weight long"
CONTEXTS = "chunk long, part int, ctx binary, room binary, docs binary, pos binary, of binary, first binary"
VERDICTS = "chunk long, pos binary, mask binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(256, 1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR-byte substring."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _power(pow(_BASE, -1, 2**64), n)[: n - ANCHOR + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def anchors(blob: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors that the strings of LENGTH bytes inside documents name."""
    ends = np.cumsum(lens)
    whole = np.zeros(len(blob), bool)  # a string that starts here ends in the same document
    for e, n in zip(ends, lens, strict=True):
        if n >= LENGTH:
            whole[e - n : e - LENGTH + 1] = True
    at, of = [], []
    low = np.uint64((1 << 20) - 1)
    for a in range(0, max(0, len(blob) - LENGTH + 1), SLICE):
        part = blob[a : a + SLICE + LENGTH - 1]
        h = _hashes(part)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, span = 1, LEFT + 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        p = (m & low).astype(np.int64)[whole[a : a + len(m)]]
        if len(p):
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]  # leftmost minima never move back
            at.append(p + a)
            of.append(h[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(at), np.concatenate(of)
    new = np.concatenate([[True], p[1:] != p[:-1]])  # a slice's first may be the last one's last
    return p[new], h[new]


def _rows(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    s = _rows(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, s, strict=True)], schema=s)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket into which Spark writes rows bucketed by a long ``x``."""
    c1, c2, u32 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32
    turn = lambda v, r: (v << u32(r)) | (v >> u32(32 - r))
    h = np.full(len(x), 42, np.uint32)
    with np.errstate(over="ignore"):
        for part in (x.astype(np.uint64).astype(np.uint32), (x.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)):
            h = turn(h ^ turn(part * c1, 15) * c2, 13) * u32(5) + u32(0xE6546B64)
        h ^= u32(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> u32(shift))) * u32(factor)
        h ^= h >> u32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def _numbers(task: int, buckets: int, run: int = 48) -> Iterator[int]:
    """Chunk numbers of a task, chosen so that ``run`` chunks in a row share a bucket: a file each, not one for each chunk."""
    low, seq = 0, 0
    by_bucket: list[np.ndarray] = []
    target = -1
    while True:
        want = (task + seq // run * 7919) % buckets
        if want != target:
            target, by_bucket = want, []
        while not by_bucket:
            x = np.arange(low, low + 4 * buckets + 64, dtype=np.int64) + (task << 32)
            hits = x[bucket_of(x, buckets) == target]
            low += len(x)
            by_bucket = hits.tolist()
        yield by_bucket.pop(0)
        seq += 1


def _to_chunks(chunk_bytes: int, buckets: int):
    """Packs rows of (doc_id, text, two keys, anything else) into chunks; what else there is goes along as is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = _numbers(TaskContext.get().partitionId(), buckets), 0
        parts: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            column = lambda k: rows.column(k).combine_chunks()
            texts = column(1).fill_null("")
            key = np.stack([column(2).to_numpy(), column(3).to_numpy().astype(np.int64)], axis=1)
            rest = b""
            if rows.num_columns > 4:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (other := rows.select(range(4, rows.num_columns))).schema) as out:
                    out.write_table(other.combine_chunks())
                rest = sink.getvalue().to_pybytes()
            blob = b"".join(x.as_buffer().to_pybytes() for x in texts)
            lens = pc.binary_length(texts).to_numpy().astype(np.int64)
            return _batch(CHUNKS, [next(numbers)], [column(0).fill_null(NO_ID).to_numpy().tobytes()], [key.tobytes()], [lens.tobytes()], [blob], [rest])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                end = min(batch.num_rows, int(np.searchsorted(sizes, done + chunk_bytes - held)) + 1)
                parts.append(batch.slice(at, end - at))
                held += int(sizes[end - 1]) - done
                at = end
                if held >= chunk_bytes:
                    yield flush()
                    held = 0
                    parts.clear()
        if parts:
            yield flush()

    return run


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["blob"], np.uint8), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            release()


def _parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Where the range of part k of evenly cut 64-bit numbers begins in the sorted ``h``."""
    return np.searchsorted(h, np.array([(k << 64) // parts for k in range(parts)], np.uint64)).tolist() + [len(h)]


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            blob, _, lens = _chunk(row)
            pos, h = anchors(blob, lens)
            u, first = np.unique(h, return_index=True)
            at = _parts_of(u, parts)
            full = [k for k in range(parts) if at[k] < at[k + 1]]
            if full:
                drawn = np.flatnonzero(u % np.uint64(DRAWN) == 0)
                leads = np.lib.stride_tricks.sliding_window_view(blob, ANCHOR)[pos[first[drawn]]]
                cuts = [(slice(at[k], at[k + 1]), slice(*np.searchsorted(drawn, [at[k], at[k + 1]]))) for k in full]
                yield _batch(REQUESTS, [row["chunk"]] * len(full), full, [u[c].tobytes() for c, _ in cuts], [leads[d].tobytes() for _, d in cuts])

    return run


def _answer(hot_chunks: int):
    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("hashes").chunks for x in c]
        found, times = np.unique(np.concatenate(asked), return_counts=True)
        shared, times = found[times > 1], times[times > 1]
        out: tuple[list, ...] = ([], [], [], [], [], [])
        part = table.column("part")[0].as_py()
        drawn: dict[int, bytes] = {}
        for chunk, h, x in zip(table.column("chunk").to_pylist(), asked, (x.as_buffer() for c in table.column("leads").chunks for x in c), strict=True):
            at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
            hit = shared[at] == h if len(shared) else np.zeros(len(h), bool)
            if hit.any():
                hot = hit & (times[at] >= hot_chunks)
                for col, v in zip(out, (chunk, part, np.packbits(hit).tobytes(), np.packbits(hot).tobytes() if hot.any() else b"", None, None), strict=True):
                    col.append(v)
            with_lead = np.flatnonzero(h % np.uint64(DRAWN) == 0)
            leads = np.frombuffer(x, np.uint8).reshape(-1, ANCHOR)
            for i in np.flatnonzero(hit[with_lead] & (times[at[with_lead]] < hot_chunks) if len(shared) else []).tolist():
                drawn[int(at[with_lead[i]])] = leads[i].tobytes()
        for k, lead in drawn.items():
            for col, v in zip(out, (None, part, None, None, lead, int(times[k])), strict=True):
                col.append(v)
        return pa.Table.from_batches([_batch(ANSWERS, *out)])

    return run


def _splitters(drawn: list[tuple[bytes, int]], parts: int) -> np.ndarray:
    """Boundaries of ``parts`` ranges of anchors, of equal weight in the sample."""
    if not drawn:
        return np.zeros(0, f"S{ANCHOR}")
    leads = np.array([x for x, _ in drawn], f"S{ANCHOR}")
    order = np.argsort(leads)
    weight = np.cumsum(np.array([w for _, w in drawn], np.float64)[order])
    return np.unique(leads[order][np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)])


def _deal(chunk: int, part: np.ndarray, n_parts: int, texts: np.ndarray, rooms: np.ndarray | None, least: np.ndarray, pos: np.ndarray, of: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each part: its distinct texts with their least documents, and all their occurrences (``of``: which text)."""
    parts = np.unique(part)
    by_part = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[by_part], parts)
    ends = np.append(bounds[1:], len(part))
    new_no = np.empty(len(part), np.int64)
    new_no[by_part] = np.arange(len(part)) - np.repeat(bounds, ends - bounds)
    occ = np.argsort(part[of], kind="stable")
    sorted_of = part[of][occ]
    occ_bounds, occ_ends = np.searchsorted(sorted_of, parts), np.searchsorted(sorted_of, parts, side="right")
    out: list[list] = [[] for _ in range(8)]
    for i, k in enumerate(parts.tolist()):
        own, o = by_part[bounds[i] : ends[i]], occ[occ_bounds[i] : occ_ends[i]]
        values = (
            chunk, n_parts + k, texts[own].tobytes(), b"" if rooms is None else rooms[own].tobytes(), least[own].tobytes(),
            pos[o].astype(np.uint32).tobytes(), new_no[of[o]].astype(np.uint32).tobytes(), (docs[o] == least[of[o]]).tobytes(),
        )
        for col, v in zip(out, values, strict=True):
            col.append(v)
    return _batch(CONTEXTS, *out)


def _distinct(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct row first is, which of them each row is, and the least document of each."""
    rows = np.ascontiguousarray(rows)
    _, first, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, of, docs)
    return first, of, least


def _contexts(parts: int, splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            blob, ids, lens = _chunk(row)
            pos, h = anchors(blob, lens)
            if not len(pos):
                continue
            u, inv = np.unique(h, return_inverse=True)
            ends = np.cumsum(lens)
            owner = np.searchsorted(ends, pos, side="right")
            docs = ids[owner]
            # Shared inside the chunk by two ids, or with another chunk.
            low, high = np.full(len(u), NO_ID), np.full(len(u), np.iinfo(np.int64).min)
            np.minimum.at(low, inv, docs)
            np.maximum.at(high, inv, docs)
            shared, hot = low < high, np.zeros(len(u), bool)
            at = _parts_of(u, parts)
            for answer in row["answers"] or []:
                own = slice(at[answer["part"]], at[answer["part"] + 1])
                for known, mask in ((shared, answer["mask"]), (hot, answer["hot"])):
                    if mask:
                        known[own] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=own.stop - own.start).astype(bool)
            left = np.minimum(pos - (ends[owner] - lens[owner]), LEFT).astype(np.uint8)
            right = np.minimum(ends[owner] - pos, LENGTH).astype(np.uint8)
            take = np.flatnonzero(shared[inv] & ~hot[inv])
            if len(take):
                padded = np.concatenate([np.zeros(LEFT, np.uint8), blob, np.zeros(LENGTH, np.uint8)])
                ctx = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[pos[take]].copy()
                room = np.stack([left[take], right[take]], axis=1)
                span = np.arange(CONTEXT)
                ctx[(span < LEFT - room[:, :1].astype(int)) | (span >= LEFT + room[:, 1:].astype(int))] = 0
                first, of, least = _distinct(np.concatenate([ctx, room], axis=1), docs[take])
                lead = np.ascontiguousarray(ctx[first, LEFT : LEFT + ANCHOR]).view(f"S{ANCHOR}").ravel()
                yield _deal(row["chunk"], np.searchsorted(splitters, lead, side="right"), 0, ctx[first], room[first], least, pos[take], of, docs[take])
            take = np.flatnonzero(hot[inv])
            if len(take):
                # String j of an anchor begins LEFT - j bytes before it.
                j = np.arange(LEFT + 1)
                i, j = np.nonzero((left[take, None] >= LEFT - j) & (right[take, None] >= ANCHOR + j))
                starts, of_docs = pos[take][i] - LEFT + j, docs[take][i]
                strings = np.lib.stride_tricks.sliding_window_view(blob, LENGTH)[starts] if len(starts) else np.zeros((0, LENGTH), np.uint8)
                if len(starts):
                    first, of, least = _distinct(strings, of_docs)
                    part = (_words(strings[first]) * _odd(-(-LENGTH // 8), 9)).sum(axis=1, dtype=np.uint64) >> np.uint64(33)
                    yield _deal(row["chunk"], (part % np.uint64(parts)).astype(np.int64), parts, strings[first], None, least, starts + LEFT, of, of_docs)

    return run


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as words of eight, in their order."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    return words.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words.

    A group of rows that agree in their first words is parted in three by its pivot's next
    word; less and greater rows are parted on by the same word, equal ones by the one after.
    All groups take a step at once.
    """
    n, width = words.shape
    order, at = np.arange(n), np.arange(n)
    group, depth = np.zeros(n, np.int64), np.zeros(1, np.int64)
    while len(at):
        sizes = np.bincount(group, minlength=len(depth))
        begin = np.cumsum(sizes) - sizes
        rows = order[at]
        value = words[rows, depth[group]]
        trio = np.sort(np.stack([value[begin], value[begin + sizes // 2], value[begin + sizes - 1]]), axis=0)
        pivot = trio[1][group]
        side = (value > pivot).astype(np.int64) - (value < pivot) + 1
        key = 3 * group + side
        counts = np.bincount(key, minlength=3 * len(depth))
        place = np.empty(len(at), np.int64)
        for k in range(3):
            own = np.flatnonzero(side == k)
            g = key[own]
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            rank = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
            place[own] = (np.cumsum(counts) - counts)[g] + rank
        order[at[place]] = rows
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        open_ = (counts > 1) & (deeper < width)
        key = np.repeat(np.arange(len(counts)), counts)
        stay = open_[key]
        at, group, depth = at[stay], (np.cumsum(open_) - 1)[key[stay]], deeper[open_]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and in that order the length of the common prefix with the row before."""
    order = multikey_quicksort(_words(rows))
    a = rows[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], common])


def shared_strings(ctx: np.ndarray, room: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, bitmaps of its strings: those a smaller document has too, and all that are whole.

    Bit j stands for the string of LENGTH bytes that begins LEFT - j bytes before the anchor.
    """
    m = len(ctx)
    hit, valid = np.zeros(m, np.uint32), np.zeros(m, np.uint32)
    f_order, f_common = _classes(ctx[:, LEFT:])
    b_order, b_common = _classes(ctx[:, LEFT - 1 :: -1])
    forward, backward = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(LEFT + 1):
        bit = np.uint32(1 << j)
        idx = np.flatnonzero((room[:, 0] >= LEFT - j) & (room[:, 1] >= ANCHOR + j))
        valid[idx] |= bit
        if len(idx) < 2:
            continue
        forward[f_order] = np.cumsum(f_common < ANCHOR + j)
        backward[b_order] = np.cumsum(b_common < LEFT - j)
        key = forward[idx] * (m + 1) + backward[idx]
        o = np.argsort(key, kind="stable")
        k = key[o]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        if len(starts) == len(k):
            continue
        d = docs[idx][o]
        least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(k))))
        hit[idx[o[least < d]]] |= bit
    return hit, valid


def same_strings(strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has a string, too."""
    order, common = _classes(strings)
    starts = np.flatnonzero(common < strings.shape[1])
    d = docs[order]
    hit = np.empty(len(d), np.uint32)
    hit[order] = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d)))) < d
    return hit


def _resolve(table: pa.Table) -> pa.Table:
    col = {n: [x.as_buffer() for c in table.column(n).chunks for x in c] for n in ("ctx", "room", "docs", "pos", "of", "first")}
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in col["docs"]])
    texts = np.concatenate([np.frombuffer(x, np.uint8) for x in col["ctx"]])
    if len(col["room"][0]):
        room = np.concatenate([np.frombuffer(x, np.uint8) for x in col["room"]]).reshape(-1, 2)
        hit, valid = shared_strings(texts.reshape(-1, CONTEXT), room, docs)
    else:
        hit, valid = same_strings(texts.reshape(-1, LENGTH), docs), np.ones(len(docs), np.uint32)
    out: tuple[list, list, list] = ([], [], [])
    base = 0
    for i, chunk in enumerate(table.column("chunk").to_pylist()):
        of = np.frombuffer(col["of"][i], np.uint32).astype(np.int64) + base
        base += len(col["docs"][i]) // 8
        first = np.frombuffer(col["first"][i], bool)
        mask = np.where(first, hit[of], valid[of])
        use = mask != 0
        if use.any():
            for c, v in zip(out, (chunk, np.frombuffer(col["pos"][i], np.uint32)[use].tobytes(), mask[use].tobytes()), strict=True):
                c.append(v)
    return pa.Table.from_batches([_batch(VERDICTS, *out)])


def _covered(n: int, verdicts: list[dict]) -> np.ndarray:
    start = np.zeros(n + LEFT + 1, bool)
    for v in verdicts:
        pos, mask = np.frombuffer(v["pos"], np.uint32).astype(np.int64), np.frombuffer(v["mask"], np.uint32)
        for j in range(LEFT + 1):
            start[pos[(mask >> np.uint32(j)) & np.uint32(1) == 1] - LEFT + j] = True
    s = np.flatnonzero(start[:n])
    edge = np.zeros(n + LENGTH + 1, np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + LENGTH, -1)
    return np.cumsum(edge)[:n] > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        blob, ids, lens = _chunk(row)
        gone = _covered(len(blob), row["verdicts"] or [])
        out: list[list] = [[] for _ in range(5)]
        end = 0
        for doc, n in zip(ids.tolist(), lens.tolist(), strict=True):
            g, data = gone[end : end + n], blob[end : end + n]
            end += n
            removed = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
            kept = hashlib.sha256(data[~g].tobytes() if removed else data.tobytes()).hexdigest()
            for c, v in zip(out, (None if doc == NO_ID else doc, n, removed, spans, kept), strict=True):
                c.append(v)
        yield _batch(RESULT, *out)


def _remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        blob, _, lens = _chunk(row)
        gone = _covered(len(blob), row["verdicts"] or [])
        texts, end = [], 0
        for n in lens.tolist():
            texts.append(blob[end : end + n][~gone[end : end + n]].tobytes().decode("utf-8", "ignore"))
            end += n
        rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
        texts = pc.if_else(rest.column("is_null"), None, pa.array(texts, pa.string()))
        for batch in rest.drop_columns("is_null").append_column("text", texts).combine_chunks().to_batches():
            yield batch


def chunk_table(rows: DataFrame, chunk_bytes: int, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``rows`` in chunks, bucketed by chunk number into buckets of about ``bucket_bytes``."""
    buckets = max(shuffle_partitions(rows.sparkSession), planned_bytes(rows) // bucket_bytes)
    return bucketed_table(rows.mapInArrow(_to_chunks(chunk_bytes, buckets), CHUNKS), "chunks", "chunk", buckets, deal=False)


def _judged(rows: DataFrame, chunk_bytes: int, oversample: int, hot_chunks: int) -> DataFrame:
    """Chunks of ``rows`` with their verdicts."""
    spark = rows.sparkSession
    with small_batches(spark):
        chunks = chunk_table(rows, chunk_bytes)
        least = 4 * shuffle_partitions(spark)
        parts = max(least, chunks.count() * chunk_bytes // (8 << 20))
        # A count of one's own keeps a task at few ranges where there are more of them than partitions allow for.
        dealt = lambda df: df if parts == least else df.repartition(parts // 4, "part")
        asked = chunks.select("chunk", "lens", "blob", F.lit(b"").alias("ids")).mapInArrow(_ask(parts), REQUESTS)
        answers = scratch_table(dealt(asked).groupBy("part").applyInArrow(_answer(hot_chunks), ANSWERS), "answers")
    drawn = answers.where("lead is not null").select("lead", "weight").orderBy(F.xxhash64("lead"), "lead").limit(oversample * parts).collect()
    splitters = _splitters([(bytes(r["lead"]), r["weight"]) for r in drawn], parts)
    told = answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "mask", "hot")).alias("answers"))
    contexts = chunks.select("chunk", "ids", "lens", "blob").join(told, "chunk", "left").mapInArrow(_contexts(parts, splitters), CONTEXTS)
    verdicts = dealt(contexts).groupBy("part").applyInArrow(_resolve, VERDICTS).groupBy("chunk").agg(F.collect_list(F.struct("pos", "mask")).alias("verdicts"))
    return chunks.join(verdicts, "chunk", "left")


def _rows_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("k1"), F.lit(0).alias("k2"))


def remove_repeats(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, oversample: int = 32, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``df(doc_id, text)``.

    The result is written to the checkpoint folder; scratch tables are gone when this returns.
    """
    spark = df.sparkSession
    with scratch_scope() as made, small_batches(spark):
        out = cut(_judged(_rows_of(df), chunk_bytes, oversample, hot_chunks).select("ids", "lens", "blob", "verdicts").mapInArrow(_digests, RESULT))
    discard(spark, made)
    return out


def without_repeats(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, oversample: int = 32, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """The rows of ``df`` with the repeated bytes taken from their texts.

    A character that lost some of its bytes goes as a whole.  Other columns stay, but for
    ``n_chars``, which is counted anew.
    """
    others = [c for c in df.columns if c != "text"]
    named = {f"c{i}": c for i, c in enumerate(others)}
    packed = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("k1"),
        F.lit(0).alias("k2"),
        F.col("text").isNull().alias("is_null"),
        *[F.col(f"`{c}`").alias(k) for k, c in named.items()],
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in named.items()), "text string"])
    out = _judged(packed, chunk_bytes, oversample, hot_chunks).select("lens", "blob", "verdicts", "rest", F.lit(b"").alias("ids")).mapInArrow(_remainders, schema)
    columns = [F.col("text") if c == "text" else F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(next(k for k, v in named.items() if v == c)).alias(c) for c in df.columns]
    return out.select(*columns)
