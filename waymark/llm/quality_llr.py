"""Quality rules: fixed rules, and a hashed n-gram log-likelihood ratio. DataFrame and SQL functions alone.

Model: words and word pairs are hashed to ``BUCKETS`` buckets. The raw multinomial counts the n-grams of every document;
the target multinomial those of trusted ones, which are at most ``SAMPLE`` labelled rows of quality 1 (a documented
bound, chosen by the ids' hash). A bucket's weight is the logarithm of target over raw probability, with the target
smoothed towards raw by PRIOR n-grams, and limited to +-CLIP. A document's score is the mean weight of its n-grams. The
threshold lies SIGMAS standard deviations below the trusted rows' mean score, but not below the middle between that
and the mean of labelled rows of quality 0 (at most ``SAMPLE`` of either, those that pass the fixed rules). Every
document is compared with it; with no trusted rows none is rejected by the model.

The weights are BUCKETS numbers, whatever the corpus; the driver takes them as a literal. Per-document work is done in
the row by higher-order functions: no shuffle of texts or words, and counting adds up before its exchange.

Defined results: a null text has no words (and fails the fixed rules, which ask for 50); rows with a null ``doc_id``
are judged but never trusted; repeated rows are judged alike (labels that a repeated id has hold for each of its rows);
further columns, whatever their names, are ignored by ``judge`` and kept by ``keep``; very long texts are judged whole;
an empty table gives no rows. Scores are rounded to nine places and summed as decimals, so the threshold, and with it
every verdict, is the same whichever way the rows lie.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_part, working_folders, written

BUCKETS = 1 << 14
SAMPLE = 10_000
PRIOR = 20_000.0
CLIP = 3.0
SIGMAS = 6.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = "[ \\t-\\r]+"  # the white space of the word pattern
SYMBOLS = "#*$%&|<>"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _t (text, null as empty), _w (words), _h (their hashes) and _n (their number)."""
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != ""))
    return out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_n", F.size("_h"))


def buckets() -> Column:
    """The buckets of a document's words and word pairs."""
    return F.expr(f"concat(transform(_h, x -> pmod(x, {BUCKETS}L)), if(_n > 1, transform(sequence(1, _n - 1), i -> pmod(xxhash64(_h[i - 1], _h[i]), {BUCKETS}L)), cast(array() as array<bigint>)))")


def with_base(words: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Adds the fixed rules' columns and, with weights, the score.

    Repeats: each three-word window becomes one number, its hash above and its place in the low bits; sorted, equal
    windows are neighbours. The places of repeated windows, in order, give the covered words.
    """
    out = words.withColumn("_m", F.expr("shiftleft(1L, cast(ceil(log2(_n + 2)) as int)) - 1"))
    keys = "if(_n < 3, cast(array() as array<bigint>), array_sort(transform(sequence(0, _n - 3), i -> (xxhash64(_h[i], _h[i + 1], _h[i + 2]) & ~_m) | cast(i as bigint))))"
    out = out.withColumn("_k", F.expr(keys.replace("array_sort", "sort_array")))
    same = "(k & ~_m) = (get(_k, j {0} 1) & ~_m) and _h[cast(k & _m as int)] = _h[cast(get(_k, j {0} 1) & _m as int)]"
    places = f"sort_array(transform(filter(_k, (k, j) -> coalesce({same.format('-')}, false) or coalesce({same.format('+')}, false)), k -> k & _m))"
    out = out.withColumn("_p", F.expr(places))
    out = out.withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> trim(BOTH ' \t\n\u000B\u000C\r' FROM x) <> '')"))
    out = out.select(
        *[c for c in out.columns if c not in ("_k", "_p", "_l", "_m")],
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(_p, named_struct('l', -9L, 's', 0L), (a, p) -> named_struct('l', p, 's', a.s + least(3L, p - a.l)), a -> a.s)").alias("n_repeat_words"),
        *([] if weights is None else [score(weights).alias("score")]),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """These columns behind a generator, which no filter passes: a filter would be rewritten over its inputs, and so
    repeat the sort of a row for each of its elements."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def labelled(labels: DataFrame, quality: int, bound: int = SAMPLE) -> DataFrame:
    """Distinct labelled ids of a quality: all, or a part chosen by hash that stays below ``bound`` (four deviations off)."""
    ids = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    return hashed_part(ids, "doc_id", int(bound - 4 * bound**0.5), ids.count() if bound > 16 else 0).withColumn("_q", F.lit(quality))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[list[float], float | None]:
    """(weight of each bucket, threshold or None)."""
    with working_folders(docs.sparkSession):
        # 2 * bound ids at most
        sample = written(labelled(labels, 1, bound).union(labelled(labels, 0, bound)).groupBy("doc_id").agg(F.max("_q").alias("_q")), "labelled")
        return _fitted(docs, sample)


def _fitted(docs: DataFrame, sample: DataFrame) -> tuple[list[float], float | None]:
    """``fit`` for a sample (doc_id, _q)."""
    words = with_words(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left"))
    grams = words.select(F.coalesce(F.col("_q"), F.lit(0)).alias("_q"), F.explode(buckets()).alias("b"))
    counted = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("_q").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counted:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    from math import log

    all_raw, all_target = sum(raw) or 1, sum(target)
    weights = [0.0] * BUCKETS
    for i in range(BUCKETS):
        if raw[i]:
            p = raw[i] / all_raw
            weights[i] = max(-CLIP, min(CLIP, log((target[i] + PRIOR * p) / (all_target + PRIOR) / p)))
    trusted = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    scored = settled(with_base(with_words(trusted), weights), "_q", "base_failed", "score").filter(~F.col("base_failed"))
    # decimals: sums don't depend on the order in which tasks end
    s = F.col("score").cast("decimal(15,9)")
    stats = {r["_q"]: (float(r["s"]), float(r["ss"]), r["n"]) for r in scored.groupBy("_q").agg(F.sum(s).alias("s"), F.sum((s * s).cast("decimal(38,18)")).alias("ss"), F.count("*").alias("n")).collect()}
    if 1 not in stats:
        return weights, None
    means = {q: s / n for q, (s, _, n) in stats.items()}
    threshold = means[1] - SIGMAS * max(0.0, stats[1][1] / stats[1][2] - means[1] ** 2) ** 0.5
    if 0 in stats and means[0] < means[1]:
        threshold = max(threshold, (means[0] + means[1]) / 2)
    return weights, round(threshold, 9)


def score(weights: list[float]) -> Column:
    """The mean weight of a document's n-grams; 0 without any."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # foldable: a literal array in the plan
    total = F.aggregate(buckets(), F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    return F.round(F.coalesce(total / F.nullif(2 * F.col("_n") - 1, F.lit(-1)), F.lit(0.0)), 9)


def judge(docs: DataFrame, labels: DataFrame, model: tuple[list[float], float | None] | None = None) -> DataFrame:
    """doc_id, the fixed rules' columns, base_failed, kept and score of every document."""
    weights, threshold = model or fit(docs, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    out = settled(with_base(with_words(docs.select("doc_id", "text")), weights), *columns)
    good = F.lit(True) if threshold is None else F.col("score") >= threshold
    return out.select(*columns[:-1], (~F.col("base_failed") & good).alias("kept"), "score")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever the names."""
    weights, threshold = fit(docs, labels)
    out = settled(with_base(with_words(docs.select(F.struct("*").alias("_doc"), "text")), weights), "_doc", "base_failed", "score").filter(~F.col("base_failed"))
    return (out if threshold is None else out.filter(F.col("score") >= threshold)).select("_doc.*")
