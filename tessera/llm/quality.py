"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule looks at one ratio of a text and votes good (1), bad (0) or abstains (null).
Documents count only through their pattern of votes, of which there are at most
3 ** (number of rules) whatever the number of documents: one aggregation counts the
patterns, expectation-maximisation on those counts estimates the class prior and, for each
rule and class, how often a cast vote is right, and the posterior is a sum of per-vote
log-odds, written as an expression over the same columns.

Texts that fail the hard base limits are rejected without a vote and take no part in EM.

Edge cases: a null or empty text has no words and fails the base limits; very long texts
are handled whole; repeated rows are judged alike; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, row_key, unpacked, with_key

SYMBOLS = r"[#*$%&|<>]"
#: A word of letters, with quotes or brackets around it and punctuation after it.
PLAIN = r"^[\"'“„«(¿¡]*\p{L}[\p{L}'’-]*[\"'”“»).,;:!?…]{0,3}$"


def with_counts(df: DataFrame) -> DataFrame:
    """``df`` with the counts of its ``text`` that the rules use, all of them prefixed ``q_``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    base = df.withColumns({"q_text": text, "q_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "q_lines": lines})
    counted = base.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("q_text", r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length("q_text") - F.length(F.regexp_replace("q_text", SYMBOLS, ""))).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_upper": F.length(F.regexp_replace("q_text", r"[^\p{Lu}]+", "")).cast("long"),
            "q_excl": (F.length("q_text") - F.length(F.regexp_replace("q_text", "!", ""))).cast("long"),
            "q_ended": F.size(F.filter("q_lines", lambda x: F.rlike(x, F.lit(r"[.?!:;\"”»)][\x20\x09-\x0D]*$")))).cast("long"),
            "q_letters": F.length(F.regexp_replace("q_text", r"\P{L}+", "")).cast("long"),
            "q_plain": F.size(F.filter("q_words", lambda w: F.rlike(w, F.lit(PLAIN)))).cast("long"),
            "q_distinct": F.size(F.array_distinct("q_words")).cast("long"),
            "q_grams": F.when(
                F.size("q_words") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), lambda i: F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2))),
            ),
        }
    ).drop("q_text", "q_words", "q_lines")
    # Positions of windows that occur more than once: neighbours in the sorted list of (hash, position).
    repeats = F.size(F.array_distinct("q_grams")) < F.size("q_grams")
    sorted_ = counted.withColumn("q_sorted", F.when(repeats, F.sort_array(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("q_grams")
    same = F.filter("q_sorted", lambda x, k: F.coalesce(F.get("q_sorted", k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("q_sorted", k + 1)["g"] == x["g"], F.lit(False)))
    at = F.sort_array(F.transform(same, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"],
    )
    return sorted_.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("q_sorted")


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def rules() -> dict[str, Column]:
    """The votes: 1 good, 0 bad, null for abstaining."""
    symbols, upper, excl = _ratio("n_symbols", "n_words"), _ratio("q_upper", "word_chars"), _ratio("q_excl", "n_words")
    dup, rep, ended = _ratio("n_dup_lines", "q_n_lines"), _ratio("n_repeat_words", "n_words"), _ratio("q_ended", "q_n_lines")
    letters, plain = _ratio("q_letters", "word_chars"), _ratio("q_plain", "n_words")
    length, variety = _ratio("word_chars", "n_words"), F.try_divide(F.col("q_distinct"), F.sqrt(F.col("n_words").cast("double")))
    return {
        "symbols": _vote(symbols, symbols < 0.05, symbols > 0.2),
        "capitals": _vote(upper, upper < 0.15, upper > 0.3),
        "shouting": _vote(excl, excl < 0.05, excl > 0.2),
        "duplicate_lines": _vote(dup, dup < 0.15, dup > 0.35),
        "repetition": _vote(rep, rep < 0.2, rep > 0.35),
        "endings": _vote(ended, ended > 0.5, ended < 0.1),
        "letters": _vote(letters, letters > 0.93, letters < 0.88),
        "plain_words": _vote(plain, plain > 0.9, plain < 0.7),
        "word_length": _vote(length, (length > 3) & (length < 9), (length < 2.2) | (length > 14)),
        "variety": _vote(variety, variety > 4, variety < 2),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(patterns: dict[tuple, int], n_rules: int, rounds: int = 200) -> tuple[float, list[tuple[float, float, float, float]]]:
    """EM over counted vote patterns.

    Returns the log-odds of the prior and, for each rule, the log-odds that a good and a bad
    vote add, with the estimated accuracies on good and on bad documents.  It starts from
    the assumption that documents with several bad votes are bad, which fixes the classes'
    meaning; a single one is left open.
    """
    total = sum(patterns.values())
    if not total:
        return 0.0, [(0.0, 0.0, 0.5, 0.5)] * n_rules
    good = {p: (0.95, 0.6, 0.05)[min(2, p.count(0))] for p in patterns}
    prior, odds = 0.0, []
    for _ in range(rounds):
        mass = sum(n * good[p] for p, n in patterns.items())
        prior_new = log((mass + 1) / (total - mass + 1))
        odds = []
        for j in range(n_rules):
            yes = [sum(n * good[p] for p, n in patterns.items() if p[j] == v) for v in (0, 1)]
            no = [sum(n * (1 - good[p]) for p, n in patterns.items() if p[j] == v) for v in (0, 1)]
            right_good, wrong_bad = (yes[1] + 1) / (yes[0] + yes[1] + 2), (no[1] + 1) / (no[0] + no[1] + 2)
            odds.append((log(right_good / wrong_bad), log((1 - right_good) / (1 - wrong_bad)), right_good, 1 - wrong_bad))
        change = 0.0
        for p in patterns:
            s = prior_new + sum(odds[j][0] if v == 1 else odds[j][1] for j, v in enumerate(p) if v is not None)
            new = 1 / (1 + exp(-max(-500.0, min(500.0, s))))
            change, good[p] = max(change, abs(new - good[p])), new
        if change < 1e-9 and abs(prior - prior_new) < 1e-9:
            break
        prior = prior_new
    return prior_new, odds


def judge(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each of ``df(doc_id, text)``: counts, ``base_failed``, ``posterior``, ``kept``, and its content key."""
    votes = rules()
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(F.col("doc_id").cast("long"), F.col("text")))
    counts = cut(
        with_counts(keyed)
        .withColumn("base_failed", base_failed())
        .withColumns({f"v_{k}": v for k, v in votes.items()})
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_k1", "_k2", *[f"v_{k}" for k in votes])
    )
    names = [f"v_{k}" for k in votes]
    patterns = {tuple(r[:-1]): r[-1] for r in counts.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*")).collect()}
    prior, odds = fit(patterns, len(names))
    score = F.lit(prior)
    for name, (yes, no, _, _) in zip(names, odds, strict=True):
        score = score + F.when(F.col(name) == 1, yes).when(F.col(name) == 0, no).otherwise(0.0)
    return counts.withColumn("posterior", 1 / (1 + F.exp(-score))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*names)


def keep_good(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    kept = judge(df, threshold).where("kept").select("_k1", "_k2").distinct()
    return unpacked(with_key(df, "doc_id", "text").join(kept, ["_k1", "_k2"], "left_semi"), df.columns)
