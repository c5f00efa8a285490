"""Language identification by a linear-chain conditional random field over words.

Each word gets a score for each language from hashed features: its byte n-grams with marks
for its beginning and end (those with a mark are its affixes) and the word itself (the
lexicon).  Learned transition scores tie neighbouring words, and forward-backward gives
every word of a text its distribution over languages, so that a text may switch languages.
A text's language is the one with the largest share of its words that have letters.

Training maximises the conditional likelihood on a bounded sample of labelled texts
(``train_docs``, of each at most ``train_words`` words in a row, from a place given by a
hash), distinct and as many of each language, taken in the order of a hash, with the text's
language as label of all its words.  Labelled texts do not switch, so transitions learn
from sequences put together from runs of words of sampled texts in different languages, half
as many as texts.  Labels, sources and ids are never inputs of a prediction.

Forward-backward runs over all texts of a run at once as one chain: a text's first word has
a transition that forgets what came before.  The chain is cut into segments whose matrix
products give the messages at the cuts, so results are exact whatever the text's length.

Edge cases: a null text, or one without letters, is ``und`` with score 0, as is every text
if there is nothing to learn from, with no spans; ties go to the smaller name; repeated rows
are predicted alike; a null id is not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD
from .shingles import slices

ORDERS = (2, 3, 4)
SEGMENT = 64
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages), scores


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words in lower case, the word number at each place, and the words of each text."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    owner, flat = pc.list_parent_indices(parts), parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(owner.filter(full).to_numpy(), minlength=len(texts))
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def features(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and the place where each word's features begin."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    n = len(data)
    lens = np.diff(offsets)
    left = np.repeat(offsets[1:], lens) - np.arange(n)  # bytes up to the word's end
    grams = np.zeros((n, len(ORDERS) + 1), np.uint32)
    valid = np.zeros((n, len(ORDERS) + 1), bool)
    with np.errstate(over="ignore"):
        h = data * np.uint32(0x9E3779B1)
        for size in range(2, max(ORDERS) + 1):
            h[: n - size + 1] = (h[: n - size + 1] ^ (h[: n - size + 1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + data[size - 1 :] * np.uint32(0xC2B2AE3D)
            if size in ORDERS:
                k = ORDERS.index(size)
                grams[:, k], valid[:, k] = h + np.uint32(size), left >= size
        # The word as a whole, once, at its first byte.
        grams[offsets[:-1], len(ORDERS)] = _whole(data, offsets)
        valid[offsets[:-1], len(ORDERS)] = True
        grams = (grams ^ (grams >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    out = (grams >> np.uint32(32 - bits)).astype(np.int64)[valid]
    each = np.add.reduceat(valid.sum(axis=1), offsets[:-1]) if n else np.zeros(0, np.int64)
    return out, np.concatenate([[0], np.cumsum(each)])


def _whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and their places."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    with np.errstate(over="ignore"):
        x = (data + np.uint32(1)) * (place.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        return np.add.reduceat(x ^ (x >> np.uint32(15)), offsets[:-1]).astype(np.uint32)


def word_scores(numbers: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each word's score for each language: its features' weights, scaled by the root of their number."""
    if len(starts) < 2:
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[numbers], starts[:-1], axis=0) / np.sqrt(np.diff(starts))[:, None].astype(np.float32)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over concatenated texts.

    ``scores``: (words, languages); ``first``: whether a word begins a text.  Returns each
    word's distribution, and with ``pairs`` the expected number of each transition.
    """
    n, k = scores.shape
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(transitions - transitions.max()).astype(np.float64)
    segs = -(-n // SEGMENT)
    e = np.ones((segs * SEGMENT, k))
    e[:n] = emit
    f = np.zeros(segs * SEGMENT, bool)
    f[:n] = first
    f[n:] = True
    e, f = e.reshape(segs, SEGMENT, k), f.reshape(segs, SEGMENT)

    def forward(state: np.ndarray, t: int) -> np.ndarray:
        """``state`` (segments, rows, languages) one word on."""
        new = (state.reshape(-1, k) @ step).reshape(state.shape)
        at = np.flatnonzero(f[:, t])
        if len(at):
            new[at] = state[at].sum(axis=2, keepdims=True) / k
        new *= e[:, t, None, :]
        return new

    product = np.broadcast_to(np.eye(k), (segs, k, k)).copy()
    for t in range(SEGMENT):
        product = forward(product, t)
        product /= product.max(axis=(1, 2), keepdims=True)
    into, back = np.empty((segs, k)), np.empty((segs, k))
    v = np.full(k, 1 / k)
    for s in range(segs):
        into[s] = v
        v = v @ product[s]
        v /= v.sum()
    v = np.ones(k)
    for s in range(segs - 1, -1, -1):
        back[s] = v
        v = product[s] @ v
        v /= v.sum()
    alpha, beta = np.empty((segs, SEGMENT, k)), np.empty((segs, SEGMENT, k))
    state = into[:, None, :]
    for t in range(SEGMENT):
        state = forward(state, t)
        state /= state.sum(axis=2, keepdims=True)
        alpha[:, t] = state[:, 0]
    state = back
    for t in range(SEGMENT - 1, -1, -1):
        beta[:, t] = state
        weighted = e[:, t] * state
        new = weighted @ step.T
        at = np.flatnonzero(f[:, t])
        if len(at):
            new[at] = weighted[at].sum(axis=1, keepdims=True) / k
        state = new / new.sum(axis=1, keepdims=True)
    alpha, beta, e = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n], e.reshape(-1, k)[:n]
    node = alpha * beta
    node /= node.sum(axis=1, keepdims=True)
    if not pairs:
        return node, None
    inside = np.flatnonzero(~first[1:])
    joint = alpha[inside][:, :, None] * step * (e * beta)[inside + 1][:, None, :]
    return node, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _first(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return first


def switched(texts: list[str], labels: list[str], n: int, seed: int = 1) -> list[list[tuple[str, str]]]:
    """``n`` sequences of runs of 3 to 12 words from texts in different languages."""
    rng = np.random.default_rng(seed)
    words = [t.split() for t in texts]
    of = {lang: [w for w, x in zip(words, labels, strict=True) if x == lang and w] for lang in sorted(set(labels))}
    of = {lang: found for lang, found in of.items() if found}
    out = []
    for _ in range(n if len(of) > 1 else 0):
        runs, last = [], None
        for _ in range(int(rng.integers(2, 6))):
            lang = str(rng.choice([x for x in of if x != last]))
            w = of[lang][int(rng.integers(len(of[lang])))]
            at = int(rng.integers(len(w)))
            runs.append((" ".join(w[at : at + int(rng.integers(3, 13))]), lang))
            last = lang
        out.append(runs)
    return out


def fit(texts: list[str], labels: list[str], mixed: list[list[tuple[str, str]]] | None = None, bits: int = 18, rounds: int = 20, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Conditional maximum likelihood by AdaGrad over the whole sample: texts of one label, and ``mixed`` sequences of labelled runs."""
    runs = [[(t, x)] for t, x in zip(texts, labels, strict=True)] + (mixed or [])
    sequence = [i for i, r in enumerate(runs) for _ in r]
    texts, labels = [t for r in runs for t, _ in r], [x for r in runs for _, x in r]
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)))
    dictionary, codes, counts = words_of(pa.array(texts, pa.string()))
    if k < 2 or not len(codes):
        return model
    gold = np.repeat([languages.index(x) for x in labels], counts)
    first = _first(np.bincount(sequence, counts, minlength=len(runs)).astype(np.int64))
    inside = ~first[1:]
    gold_pairs = np.bincount(gold[:-1][inside] * k + gold[1:][inside], minlength=k * k).reshape(k, k)
    numbers, starts = features(dictionary, bits)
    scale = 1 / np.sqrt(np.diff(starts))
    owner = np.repeat(np.arange(len(dictionary)), np.diff(starts))
    gold_words = np.stack([np.bincount(codes[gold == c], minlength=len(dictionary)) for c in range(k)], axis=1)
    sum_w, sum_t = np.full((1 << bits, k), 1e-8), np.full((k, k), 1e-8)
    total = len(codes)
    for _ in range(rounds):
        node, pairs = marginals(word_scores(numbers, starts, model.weights)[codes], first, model.transitions, pairs=True)
        grad_u = (gold_words - np.stack([np.bincount(codes, node[:, c], len(dictionary)) for c in range(k)], axis=1)) * (scale / total)[:, None]
        grad = np.stack([np.bincount(numbers, grad_u[owner, c], 1 << bits) for c in range(k)], axis=1) - decay * model.weights
        sum_w += grad**2
        model.weights += (rate * grad / np.sqrt(sum_w)).astype(np.float32) * (grad != 0)
        grad_t = (gold_pairs - pairs) / total - 1e-3 * model.transitions
        sum_t += grad_t**2
        model.transitions += rate * grad_t / np.sqrt(sum_t)
    return model


SPANS = "array<struct<lang: string, n_words: int>>"
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int32())]))


def _spans(best: np.ndarray, first: np.ndarray, counts: np.ndarray, languages: list[str]) -> pa.Array:
    """Runs of words with one label, text by text."""
    starts = np.flatnonzero(first | np.concatenate([[True], best[1:] != best[:-1]]))
    runs = pa.StructArray.from_arrays(
        [pa.DictionaryArray.from_arrays(pa.array(best[starts], pa.int32()), pa.array(languages, pa.string())).cast(pa.string()), pa.array(np.diff(np.append(starts, len(best))), pa.int32())],
        fields=list(_SPANS.value_type),
    )
    offsets = np.searchsorted(starts, np.concatenate([[0], np.cumsum(counts)]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs).cast(_SPANS)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float], pa.Array]:
    """Language, score and spans of each text."""
    langs, scores, spans = [], [], []
    bits = model.weights.shape[0].bit_length() - 1
    for _, part in slices(texts):
        dictionary, codes, counts = words_of(part)
        if not len(codes) or not model.languages:
            langs += [UNKNOWN] * len(part)
            scores += [0.0] * len(part)
            spans.append(pa.array([[]] * len(part), _SPANS))
            continue
        letters = pc.match_substring_regex(dictionary, r"\p{L}").to_numpy(zero_copy_only=False)[codes]
        first = _first(counts)
        node, _ = marginals(word_scores(*features(dictionary, bits), model.weights)[codes], first, model.transitions)
        spans.append(_spans(node.argmax(axis=1), first, counts, model.languages))
        sums = np.vstack([np.zeros(node.shape[1]), np.cumsum(node * letters[:, None], axis=0)])
        ends = np.cumsum(counts)
        share = sums[ends] - sums[ends - counts]
        with_letters = np.concatenate([[0], np.cumsum(letters)])
        n = with_letters[ends] - with_letters[ends - counts]
        best = share.argmax(axis=1)
        for i in range(len(part)):
            langs.append(model.languages[best[i]] if n[i] else UNKNOWN)
            scores.append(min(1.0, max(0.0, float(share[i, best[i]] / n[i]))) if n[i] else 0.0)
    return langs, scores, pa.concat_arrays(spans) if spans else pa.array([], _SPANS)


def training_sample(df: DataFrame, train_docs: int, train_words: int = 2000) -> tuple[list[str], list[str]]:
    """At most ``train_docs`` distinct labelled texts outside the held-out fold, as many of each language, in the order of a hash of the text.

    Of a longer text, ``train_words`` words in a row come to the driver.

    Places that a language of few texts leaves go to the others.  Languages are lost only
    where there are more of them than places.
    """
    labelled = df.where("lang is not null and text is not null and not coalesce(held_out, true)").select("text", "lang")
    found = labelled.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).orderBy("n", "lang").collect()
    if not found:
        return [], []
    shares, left = [], train_docs
    for k, r in enumerate(found):
        places = max(1, left // (len(found) - k))
        left = max(0, left - min(places, r["n"]))
        shares.append((r["lang"], places, (2.0 * places + 20) / max(1, r["n"])))
    places = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, places int, below double"))
    u = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 11).cast("double") / float(2**53)
    near = labelled.withColumn("u", u).join(places, "lang").where(F.col("u") <= F.col("below")).groupBy("lang", "text").agg(F.min("u").alias("u"), F.min("places").alias("places"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    rows = near.withColumn("rank", rank).where("rank <= places").orderBy("rank", "u", "lang").limit(train_docs)
    parts = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    start = F.pmod(F.xxhash64("text", F.lit(2)), F.greatest(F.lit(1), F.size(parts) - train_words + 1)).cast("int") + 1
    rows = rows.select("lang", F.array_join(F.slice(parts, start, train_words), " ").alias("text")).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(df: DataFrame, train_docs: int = 800, train_words: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of each row of ``df(doc_id, text, lang)``.

    ``spans``: the text's words from first to last as runs of one language each, word by word the likeliest.
    """
    spark = df.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = df.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (F.crc32(doc_id.cast("string")) % 4 == 2).alias("held_out"))
    texts, labels = training_sample(rows, train_docs, train_words)
    model = fit(texts, labels, switched(texts, labels, len(texts) // 2))
    sent = spark.sparkContext.broadcast((model.languages, model.weights, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        received = Model(*sent.value)
        for batch in batches:
            langs, scores, spans = predict(received, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}")
