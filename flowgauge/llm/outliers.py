"""Quality rules: robust multivariate outliers.

Every document becomes a short vector of transformed statistics. For each language
and source the minimum covariance determinant estimate gives a centre and a shape
that junk cannot pull along, and documents whose Mahalanobis distance from it is
beyond a chi-square limit are rejected.

The estimate runs as Spark aggregates over all rows: from two deterministic starts
(medians with absolute deviations, and the classical moments), concentration steps
keep the nearest ``SHARE`` of a group's rows and take their mean and covariance, until
the determinant falls no more; of the two ends the one with the smaller determinant
stays. A group is never gathered, whatever its size: each step is one quantile sketch
and one set of sums per group, for the groups whose determinant still falls.
"""

import math
import re
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowgauge.llm.shared import add_columns, pick, positions
from flowgauge.session import stored

SHARE = 0.75            # part of a group the determinant is minimised over
FALL = 1e-6             # a step that lowers the log determinant by less than this was the last
TAIL = 1e-7             # chance of rejecting a row of a normal group
LEAST_ROWS = 50         # smaller groups are judged by all rows of the language, then of the table
# Spread below which a statistic says nothing, in its transformed unit.
FLOORS = (0.05, 0.05, 0.06, 0.06, 0.03)
# Most texts repeat no line and no words, so their robust spread is 0 where some repeats are
# common. For these two the least spread of a group is that which its 95th percentile of
# deviations has in a normal group, up to a limit that junk cannot push.
REPEATS, REPEAT_TAIL, REPEAT_WIDE = (2, 3), 0.95, 0.12
P = len(FLOORS)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def repeated_words(words):
    """Words that lie in a five-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    first, covered = {}, bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + 5] = covered[j:j + 5] = b"\x01" * 5
    return sum(covered)


def text_stats(text):
    words = text.encode("utf-8", "replace").split()      # ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(UPPER.findall(text)))


def _batch_stats(at):
    def make(batch):
        rows = [text_stats(t or "") for t in batch.column(at).to_pylist()]
        columns = zip(*rows) if rows else [[]] * 7
        return [pa.array(c, pa.int64()) for c in columns]
    return make


def with_statistics(docs, text, lang, source):
    """``docs`` with the counts, the base verdict, the group and the vector."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    counted = add_columns(docs, _batch_stats(docs.columns.index(text)), STATS)
    known = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in (lang, source)]
    return counted.withColumns({
        "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
        "lang_key": known[0],
        "group_key": F.concat_ws("\x1f", *known),
        "x0": F.log((chars + 50) / (n + 10)),
        "x1": F.sqrt(F.col("n_symbols") / (n + 10)),
        "x2": F.sqrt(F.col("n_dup_lines") / (lines + 10)),
        "x3": F.sqrt(F.col("n_repeat_words") / (n + 10)),
        "x4": F.sqrt(F.col("n_upper") / (chars + 50)),
    })


def chi2_cdf(x, k):
    """Series of the regularised lower incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-15:
        term *= z / (a + i)
        total += term
        i += 1
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(q, k):
    low, high = 1e-9, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)   # a trimmed covariance is too small by this
# The tail beyond double precision of the series: Wilson and Hilferty's cube root.
LIMIT = P * (1 - 2 / (9 * P) + NormalDist().inv_cdf(1 - TAIL) * math.sqrt(2 / (9 * P))) ** 3

XS = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MODEL = "group_key string, start int, centre array<double>, inverse array<double>, log_det double, n long, floors array<double>"


def _distance(centre="centre", inverse="inverse"):
    off = [F.col(x) - F.col(centre)[i] for i, x in enumerate(XS)]
    return sum((off[i] * off[j] * F.col(inverse)[i * P + j] * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))


def _models(moments):
    """Mean and inverse covariance of each (group, start) from its sums."""
    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n = max(row.m, 1)
                centre = np.array([getattr(row, f"s{i}") for i in range(P)]) / n
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = getattr(row, f"q{i}{j}") / n - centre[i] * centre[j]
                cov = np.nan_to_num(cov) * row.scale + np.diag(np.square(row.floors))
                out.append((row.group_key, row.start, centre.tolist(), np.linalg.inv(cov).ravel().tolist(),
                            float(np.linalg.slogdet(cov)[1]), int(row.n), row.floors))
            yield pd.DataFrame(out, columns=["group_key", "start", "centre", "inverse", "log_det", "n", "floors"])
    return moments.mapInPandas(run, MODEL)


def _moments(rows, scale, *by):
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(XS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), *sums).withColumn("scale", F.lit(scale))


def _pools(vectors):
    """The group whose estimate judges each language and source, and the wider ones that
    its rows count for as well: those that judge some small group."""
    sizes = vectors.groupBy("lang_key", "group_key").agg(F.count(F.lit(1)).alias("n"))
    by_lang = sizes.groupBy("lang_key").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    sized = stored(sizes.join(by_lang, "lang_key"), "sizes")
    small, wide = F.col("n") < LEAST_ROWS, F.col("n_lang") >= LEAST_ROWS
    pool = F.when(~small, F.col("group_key")).when(wide, F.col("lang_key")).otherwise(F.lit(""))
    to_all = sized.filter(~wide).limit(1).count() > 0
    also = F.filter(F.array(F.when(~small, F.col("group_key")), F.when(wide & (F.col("least") < LEAST_ROWS), F.col("lang_key")),
                            F.lit("") if to_all else F.lit(None).cast("string")), lambda x: x.isNotNull())
    return sized.select("group_key", pool.alias("pool"), also.alias("counts_for"))


def fit(vectors):
    """One row per language and source: the centre and inverse covariance it is judged
    by. ``vectors`` has lang_key, group_key and x0..x4; it is read a few times a step."""
    pools = _pools(vectors)
    vectors = vectors.join(pools, "group_key").select(F.explode("counts_for").alias("group_key"), *XS)
    best = _estimates(vectors)
    return stored(pools.join(best.withColumnRenamed("group_key", "pool"), "pool").select("group_key", "centre", "inverse"), "models")


def _estimates(vectors):
    medians = vectors.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(XS)])
    medians = stored(medians.filter(F.col("n") >= LEAST_ROWS), "medians")
    near = vectors.join(medians, "group_key")
    spread = near.groupBy("group_key", "n").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), [0.5, REPEAT_TAIL], 1000).alias(f"d{i}") for i, x in enumerate(XS)])
    spread = stored(spread.withColumn("floors", F.array(*[_floor(i) for i in range(P)])), "spread")
    # As sums of a set with one row: mean m, second moment m*m plus the spread.
    robust = spread.select(
        "group_key", F.lit(0).alias("start"), "n", "floors", F.lit(1).cast("long").alias("m"), F.lit(1.0).alias("scale"),
        *[F.col(f"m{i}").cast("double").alias(f"s{i}") for i in range(P)],
        *[(F.col(f"m{i}") * F.col(f"m{j}") + (F.pow(F.col(f"d{i}")[0] * 1.4826, 2) if i == j else F.lit(0.0))).alias(f"q{i}{j}")
          for i, j in PAIRS])
    classical = _moments(vectors, 1.0, "group_key").join(spread.select("group_key", "n", "floors"), "group_key").select(
        "group_key", F.lit(1).alias("start"), "n", "floors", "m", "scale",
        *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS])
    # The starts are no estimates of SHARE of the rows: their determinants do not count.
    falling = _concentrated(vectors, stored(_models(robust.unionByName(classical)), "models"))
    steps = [falling]
    while not falling.isEmpty():
        stepped = _concentrated(vectors, falling)
        steps.append(stepped)
        before = falling.select("group_key", "start", F.col("log_det").alias("before"))
        falls = stepped.join(before, ["group_key", "start"]).filter(F.col("log_det") < F.col("before") - FALL)
        falling = stored(falls.drop("before"), "models")
    models = reduce(lambda a, b: a.unionByName(b), steps)
    best = F.min(F.struct("log_det", "start", "centre", "inverse", "n")).alias("best")
    return models.groupBy("group_key").agg(best).select("group_key", "best.centre", "best.inverse")


def _floor(i):
    if i not in REPEATS:
        return F.lit(FLOORS[i])
    normal = NormalDist().inv_cdf((1 + REPEAT_TAIL) / 2)
    return F.least(F.lit(REPEAT_WIDE), F.greatest(F.lit(FLOORS[i]), F.col(f"d{i}")[1] / normal))


def _concentrated(vectors, models):
    """One concentration step of every model: the estimate from its nearest rows."""
    at = vectors.join(models, "group_key").withColumn("d2", _distance())
    cuts = stored(at.groupBy("group_key", "start").agg(F.percentile_approx("d2", SHARE, 1000).alias("cut")), "cuts")
    kept = at.join(cuts, ["group_key", "start"]).filter(F.col("d2") <= F.col("cut"))
    return stored(_models(_moments(kept, CONSISTENCY, "group_key", "start", "n", "floors")), "models")


def judged(vectors, models):
    """Adds distance2 (null without an estimate) and kept."""
    at = vectors.join(models, "group_key", "left").withColumn(
        "distance2", F.when(F.col("centre").isNotNull(), _distance()))
    return at.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > LIMIT, F.lit(False)))


def quality(docs):
    """One row per document: doc_id, the counts, base_failed, distance2, kept.

    A null text counts as empty and fails the base rule; a null language or source is
    a value of its own; groups under ``LEAST_ROWS`` rows are judged by the estimate over all
    rows of their language, failing that of the table, failing that by the base rule alone; repeated rows are judged one by one and alike; an empty table gives none."""
    plain = pick(docs, "doc_id", "text", "lang", "source")
    vectors = stored(with_statistics(plain, "text", "lang", "source").drop("text"), "vectors")
    return judged(vectors, fit(vectors)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def keep_good(docs):
    """The documents that ``quality`` keeps, with all their columns."""
    plain, at = positions(docs, "text", "lang", "source")
    vectors = with_statistics(plain, at["text"], at["lang"], at["source"])
    models = fit(stored(vectors.select("lang_key", "group_key", *XS), "vectors"))
    return judged(vectors, models).filter("kept").select(*plain.columns).toDF(*docs.columns)
