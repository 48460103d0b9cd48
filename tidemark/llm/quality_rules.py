"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Counts of a text give a vector of transformed statistics. For each group the minimum-covariance-determinant
estimate is sought from two deterministic starts (spread by coordinate; spatial signs) with concentration
steps: take the share H of rows nearest by Mahalanobis distance, re-estimate place and covariance from them,
repeat; the start that ends with the smaller determinant wins. Documents farther than a chi-square quantile
are rejected.

A step is two aggregations with partial sums over the small vectors (a quantile of the distances, then sums
of products), whatever the sizes of the groups, and gives one row a group and start. Estimates exist for groups,
languages and all rows; a group's is drawn toward its language's, that toward the one of all rows, and that toward a wide
one, each with the weight of WEIGHT rows, so that small groups lean on larger ones and no size switches a rule off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back, give_back, same, small
from tidemark.session import cut

#: Share of a group's rows that the estimate rests on.
H = 0.75
#: Rows that an estimate's wider one counts as.
WEIGHT = 100
STEPS = 3
#: Probability that a clean normal row is rejected.
TAIL = 1e-9
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:\"'()[]{}=+~^_`@\\/"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic -> the standard deviation that is added to its estimate, so that constant columns don't reject small changes.
FLOORS = {"words": 0.25, "length": 0.06, "symbols": 0.25, "dup_lines": 0.5, "repeats": 0.08, "upper": 0.06, "marks": 0.06}
#: Standard deviations of the wide estimate that all rows' one is drawn toward.
WIDE = {"words": 1.2, "length": 0.25, "symbols": 1.0, "dup_lines": 1.5, "repeats": 0.25, "upper": 0.2, "marks": 0.2}
P = len(FLOORS)


def repeated(words: list[bytes]) -> int:
    """Number of words in three-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-2] * len(known) + ids[1:-1]
    if len(known) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, count = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = count[back] > 1
    in_window = np.zeros(n + 2, bool)
    for k in range(3):
        in_window[k : k + n] |= again
    return int(in_window.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The five COUNTS, then upper-case A-Z and MARKS."""
    if not text:
        return (0,) * 7
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n = len(data)
    return len(words), chars, n - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), n - len(data.translate(None, UPPER)), n - len(data.translate(None, MARKS))


_COUNTED = "struct<" + ",".join(f"{c}:bigint" for c in (*COUNTS, "n_upper", "n_marks")) + ">"


def counted(text: Column) -> Column:
    """The counts of each text; null counts as empty."""

    @F.arrow_udf(_COUNTED)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([count_text(x.as_py()) for x in texts], np.int64).reshape(-1, 7)
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], [*COUNTS, "n_upper", "n_marks"])
        give_back()

    # as far as the optimiser knows, so that a filter on the counts isn't moved below them and counts each text again
    return made.asNondeterministic()(text)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _c (the counts), base_failed and _x (the vector; the zero vector if there are no words).

    Columns of docs of these names are replaced.
    """
    c = lambda name: F.col(f"_c.{name}").cast("double")
    n, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    vector = [F.log(n), F.log(chars / n), F.log1p(20 * c("n_symbols") / n), F.log1p(c("n_dup_lines")), c("n_repeat_words") / n, F.sqrt(c("n_upper") / chars), F.sqrt(c("n_marks") / chars)]
    return (
        docs.withColumn("_c", counted(F.col(text)))
        .withColumn("base_failed", (F.col("_c.n_words") < 50) | (100 * F.col("_c.n_repeat_words") > 50 * F.col("_c.n_words")))
        .withColumn("_x", F.array(*vector))
    )


def chi2_cdf(x: float, k: float) -> float:
    """Lower regularised gamma function at (k / 2, x / 2), by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    i = 0
    while term > total * 1e-17:
        i += 1
        term *= x / (a + i)
        total += term
    return min(1.0, math.exp(a * math.log(x) - x - math.lgamma(a)) * total)


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


#: Makes the covariance of the H nearest of normal rows consistent with that of all.
CONSISTENT = H / chi2_cdf(chi2_quantile(H, P), P + 2)


def _fit(n: float, sums: np.ndarray, products: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Place, covariance and its inverse (flat), and log determinant from sums of a group's nearest rows."""
    mean, full, at = sums / n, np.empty((P, P)), np.triu_indices(P)
    full[at] = full.T[at] = products / n
    cov = (full - np.outer(mean, mean)) * scale + np.diag([x * x for x in FLOORS.values()])
    return mean, cov.ravel(), np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])


_ESTIMATE = "struct<mean:array<double>,cov:array<double>,inverse:array<double>,logdet:double>"


def _estimator(scale: float):
    @F.pandas_udf(_ESTIMATE)
    def estimate(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_fit(a, np.asarray(b), np.asarray(c), scale) for a, b, c in zip(n, sums, products)], columns=["mean", "cov", "inverse", "logdet"])

    return estimate


def drawn(levels: list[tuple[float, np.ndarray, np.ndarray]], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Place and inverse covariance (flat) from (rows, place, covariance) of all rows, a language and a group, in that order.

    Each level keeps the share rows / (rows + weight) of its own and takes the rest from the level before; what all rows'
    covariance takes is WIDE's.
    """
    place, cov = levels[0][1], np.diag([x * x for x in WIDE.values()])
    for rows, mean, own in levels:
        share = rows / (rows + weight)
        place, cov = share * mean + (1 - share) * place, share * own + (1 - share) * cov
    return place, np.linalg.inv(cov).ravel()


def _drawer(weight: float):
    @F.pandas_udf("struct<mean:array<double>,inverse:array<double>>")
    def made(levels: pd.Series) -> pd.DataFrame:
        each = ([(x["n"], np.asarray(x["mean"]), np.asarray(x["cov"]).reshape(P, P)) for x in row] for row in levels)
        return pd.DataFrame([drawn(x, weight) for x in each], columns=["mean", "inverse"])

    return made


def _moments(of: list[Column]) -> list[Column]:
    return [
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.array(*[F.sum(x) for x in of]).alias("_sums"),
        F.array(*[F.sum(of[i] * of[j]) for i in range(P) for j in range(i, P)]).alias("_products"),
    ]


def distance2(x: Column, mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    y = [x[i] - mean[i] for i in range(P)]
    return sum((y[i] * sum((y[j] * inverse[i * P + j] for j in range(1, P)), y[0] * inverse[i * P]) for i in range(1, P)), y[0] * sum((y[j] * inverse[j] for j in range(1, P)), y[0] * inverse[0]))


def _keys(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """(_lang, _source, _adds): the estimates that a row of a language and source adds to, and is judged by."""
    own = F.concat(F.lit("1 "), F.to_json(F.struct("_lang", "_source")))
    wider = F.concat(F.lit("2 "), F.to_json(F.struct("_lang")))
    return counts.withColumnsRenamed({lang: "_lang", source: "_source"}).select("_lang", "_source", F.array(F.lit("3"), wider, own).alias("_adds"))


def fit(counted_docs: DataFrame, lang: str = "lang", source: str = "source", weight: float = WEIGHT) -> DataFrame:
    """(_lang, _source, _e) with the estimate that judges a language and source, from rows of with_counts() that don't fail the
    base rules. A checkpoint of a row each. Null languages and sources are groups like others; languages and sources all of
    whose rows fail the base rules have none.
    """
    keys = small(cut(_keys(counted_docs.where(~F.col("base_failed")).select(lang, source).distinct(), lang, source)))
    rows = (
        counted_docs.where(~F.col("base_failed")).select(F.col(lang).alias("_l"), F.col(source).alias("_s"), "_x")
        .join(keys, same(F.col("_l"), F.col("_lang")) & same(F.col("_s"), F.col("_source")))
        .select(F.explode("_adds").alias("_key"), "_x")
    )
    rows = cut(rows)
    x = [F.col("_x")[i] for i in range(P)]
    spread = small(cut(rows.groupBy("_key").agg(
        F.array(*[F.percentile_approx(v, F.lit(0.5), F.lit(2000)) for v in x]).alias("_mid"),
        F.array(*[F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.75)), F.lit(2000)) for v in x]).alias("_q"),
    ).where(F.lit(True)).select("_key", "_mid", F.transform("_q", lambda q: (q[1] - q[0]) / 1.349).alias("_sd"))))
    floor = F.array(*map(F.lit, FLOORS.values()))
    wide = F.zip_with("_sd", floor, lambda a, b: F.sqrt(a * a + b * b))
    zero = [F.lit(0.0)] * (P * P)
    inverse = F.transform(wide, lambda s: 1 / (s * s))
    plain = [inverse[i // P] if i % P == i // P else zero[0] for i in range(P * P)]
    first = spread.select("_key", F.lit(0).alias("_start"), F.struct(F.col("_mid").alias("mean"), F.array(*plain).alias("inverse")).alias("_e"))
    # spatial signs: directions from the middle, each of length 1 in units of spread, back in the units of the data
    centred = rows.join(spread, "_key").select("_key", F.zip_with(F.zip_with("_x", "_mid", lambda a, b: a - b), wide, lambda a, b: a / b).alias("_y"), wide.alias("_w"))
    norm = F.sqrt(F.aggregate("_y", F.lit(0.0), lambda s, v: s + v * v))
    signs = centred.select("_key", F.transform(F.zip_with("_y", "_w", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v: F.when(norm > 0, v["a"] * v["b"] / norm * math.sqrt(P)).otherwise(0.0)).alias("_x"))
    second = signs.groupBy("_key").agg(*_moments(x)).join(spread, "_key").select("_key", F.lit(1).alias("_start"), F.struct(F.col("_mid").alias("mean"), _estimator(1.0)("_n", "_sums", "_products")["inverse"].alias("inverse")).alias("_e"))
    now = small(cut(first.unionByName(second)))
    for _ in range(STEPS):
        near = rows.join(now, "_key").select("_key", "_start", "_x", distance2(F.col("_x"), F.col("_e.mean"), F.col("_e.inverse")).alias("_d"))
        limit = small(cut(near.groupBy("_key", "_start").agg(F.percentile_approx("_d", F.lit(H), F.lit(2000)).alias("_limit"))))
        step = near.join(limit, ["_key", "_start"]).where("_d <= _limit").groupBy("_key", "_start").agg(*_moments(x))
        now = small(cut(step.select("_key", "_start", _estimator(CONSISTENT)("_n", "_sums", "_products").alias("_e"))))
    best = now.groupBy("_key").agg(F.min_by("_e", F.struct(F.col("_e.logdet"), F.col("_start"))).alias("_e"))
    sized = best.join(rows.groupBy("_key").agg(F.count(F.lit(1)).cast("double").alias("n")), "_key")
    sized = small(cut(sized.select("_key", F.struct("n", F.col("_e.mean").alias("mean"), F.col("_e.cov").alias("cov")).alias("_one"))))
    levels = keys.select("_lang", "_source", F.posexplode("_adds").alias("at", "_key")).join(sized, "_key")
    levels = levels.groupBy("_lang", "_source").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "_one"))), lambda v: v["_one"]).alias("_levels"))
    return small(cut(levels.select("_lang", "_source", _drawer(weight)("_levels").alias("_e"))))


def judged(counted_docs: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """counted_docs without _x, with distance2 (null without an estimate) and kept, which replace columns of these names."""
    limit = chi2_quantile(1 - tail, P)
    out = aside(counted_docs).join(estimates, same(F.col(f"in_{lang}"), F.col("_lang")) & same(F.col(f"in_{source}"), F.col("_source")), "left")
    out = out.withColumn("distance2", distance2(F.col("in__x"), F.col("_e.mean"), F.col("_e.inverse")))
    kept = ~F.col("in_base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))
    return back(out, [c for c in counted_docs.columns if c != "_x"], F.col("distance2"), kept.alias("kept"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **how) -> DataFrame:
    """The rows of docs that pass, unchanged.

    Texts are counted twice, once for the estimates and once for the verdict, and never shuffled. Null and
    empty texts have no words and go; repeated rows are judged alike; an empty table stays empty.
    """
    vectors = cut(with_counts(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text")), "_text").select("lang", "source", "base_failed", "_x"))
    estimates = fit(vectors, **how)
    out = judged(with_counts(aside(docs), f"in_{text}"), estimates, f"in_{lang}", f"in_{source}").where("kept")
    return out.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
