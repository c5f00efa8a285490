"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are dealt by a hash of their id into groups of bounded size, and each group is
packed on its own, largest piece first.  Open bins are kept in order of the room they have
left; the search starts at the first bin that has room and goes on to its successors until
a bin is compatible, so a piece lands in the tightest bin that may hold it.  A bin carries
a bitmap of the duplicate clusters in it (no two pieces of one cluster share a bin) and
bitmaps of the sources seen once, twice, ... (at most ``per_source`` pieces of a source).
Bitmaps have a bit for each cluster or source of the group, so their answers are exact.

A document longer than a bin fills whole bins with its first pieces; the rest is packed.

Edge cases: a null or empty text takes no room and gets no bin (null); a null source is a
source of its own; repeated rows belong to one cluster and never share a bin; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, word_count

SCHEMA = "doc_id long, size long, source string, piece int, start long, length long, bin string, offset long"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """Place (length, source number, cluster number) in the given order; returns (bin, offset) of each."""
    order: list[tuple[int, int]] = []  # (room left, bin), ascending
    clusters: list[int] = []
    seen: list[list[int]] = []  # of each bin, bitmaps of sources seen more than 0, 1, ... times
    placed = []
    for length, source, cluster in pieces:
        c_bit, s_bit = 1 << cluster, 1 << source
        at = bisect_left(order, (length, -1))
        while at < len(order) and (clusters[order[at][1]] & c_bit or seen[order[at][1]][per_source - 1] & s_bit):
            at += 1
        if at == len(order):
            room, b = capacity, len(clusters)
            clusters.append(0)
            seen.append([0] * per_source)
        else:
            room, b = order.pop(at)
        clusters[b] |= c_bit
        for k in range(per_source):
            if not seen[b][k] & s_bit:
                seen[b][k] |= s_bit
                break
        placed.append((b, capacity - room))
        if room > length:
            insort(order, (room - length, b))
    return placed


def pack(df: DataFrame, capacity: int = 2048, per_source: int = 3, docs_per_group: int = 2000, words_per_group: int = 4_000_000, cluster: str | None = None) -> DataFrame:
    """Pack all rows of ``df(doc_id, text, source)``; one result row for each piece.

    ``cluster`` names a column with the duplicate cluster of a row, such as the components of
    a near-duplicate join; without it equal texts are a cluster.
    """
    recs = cut(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col(f"`{cluster}`") if cluster else F.col("text")).alias("cluster"),
        )
    )
    rows, words = recs.agg(F.count("*"), F.sum("size")).first()
    groups = max(1, -(-rows // docs_per_group), -(-(words or 0) // words_per_group))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "source"], ascending=[False, True, True], kind="stable")
        sources = pdf["source"].fillna("\0null")
        s_no, c_no = pd.factorize(sources)[0], pd.factorize(pdf["cluster"])[0]
        out, todo = [], []
        full = 0
        for k, (doc, size, source) in enumerate(zip(pdf["doc_id"], pdf["size"], pdf["source"], strict=True)):
            whole, rest = divmod(int(size), capacity)
            doc, source = (None if pd.isna(doc) else int(doc)), (None if pd.isna(source) else source)
            for i in range(whole):
                out.append([doc, size, source, i, i * capacity, capacity, f"f{full}", 0])
                full += 1
            if rest:
                todo.append((rest, int(s_no[k]), int(c_no[k]), [doc, size, source, whole, whole * capacity, rest]))
            elif not whole:
                out.append([doc, size, source, 0, 0, 0, None, None])
        todo.sort(key=lambda x: -x[0])
        for (b, offset), (*_, row) in zip(best_fit([x[:3] for x in todo], capacity, per_source), todo, strict=True):
            out.append([*row, f"b{b}", offset])
        res = pd.DataFrame(out, columns=["doc_id", "size", "source", "piece", "start", "length", "bin", "offset"]).astype({"doc_id": "Int64", "offset": "Int64"})
        res["bin"] = f"{int(pdf['grp'].iloc[0])}-" + res["bin"]
        return res

    dealt = recs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", "cluster", F.lit("pack")), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInPandas(pack_group, SCHEMA)
