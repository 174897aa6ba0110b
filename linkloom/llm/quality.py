"""Quality rules: documents whose statistics lie far from those of their language and source.

Each document gets a vector of transformed statistics (words, word length, symbols, repeated lines, repeated words). For
each pair of language and source the minimum-covariance-determinant estimate gives the centre and shape of the bulk:
from three deterministic starts (distances from the median in units of the median deviation, as sum of squares, maximum
and sum), concentration steps keep the ``H`` nearest of all rows and estimate again; the start with the smallest
determinant wins and is followed by one reweighting step. Documents beyond ``CUTOFF`` in squared Mahalanobis distance
are rejected.

* Statistics are rounded to 1/256, so sums are sums of whole numbers and verdicts do not depend on the order of rows.
* The nearest ``H`` are found by a histogram of the logarithm of the distance, so no group is sorted or gathered: every
  step is a grouped count and a grouped sum with map-side combine, whatever share of the rows a source holds.
* A variance floor keeps statistics that are constant in the bulk (no symbols at all, say) from rejecting small deviations,
  and small groups lean on the estimate of all rows by ``n / (n + PRIOR)``; no group is too small.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.arrays import let, spread
from linkloom.llm.prefilter import drop_keys
from linkloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SCALE = 256
H = 0.75  # share of the rows kept by a concentration step
STEPS = 3
FLOORS = (0.4, 0.1, 0.5, 0.5, 0.5)  # least standard deviation of each transformed statistic
DIMS = len(FLOORS)
CONSISTENT_H = 1.413  # H / P(chi2 with DIMS + 2 degrees <= the H quantile of chi2 with DIMS degrees)
REWEIGHT = 12.833  # 0.975 quantile of chi2 with five degrees of freedom
CONSISTENT_REWEIGHT = 1.055
PRIOR = 50
CUTOFF = 45.0  # a normal vector of five statistics lies beyond with a probability below 1e-7
PAIRS = [(j, k) for j in range(DIMS) for k in range(j + 1)]


def _repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more."""

    def covered(h):
        # neighbours in hash order show the repeated windows; their positions in text order give the words they cover
        both = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s):
            hit = F.filter(
                F.transform(s, lambda x, k: F.when(
                    x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]), x["i"])),
                lambda x: x.isNotNull())
            return let(F.array_sort(hit), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(both, positions))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 5, 0).otherwise(let(hashes, covered))


def base_statistics(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w).cast("long").alias("repeated")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup = let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))
    got = docs.select(*keep, by_word.alias("_w"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                      dup.cast("long").alias("n_dup_lines"))
    n, rep = F.col("_w.n"), F.col("_w.repeated")
    return got.select(*keep, n.alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols",
                      "n_dup_lines", rep.alias("n_repeat_words"), ((n < 10) | (rep * 100 > n * 20)).alias("base_failed"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log(n), F.log((F.col("word_chars") + 1) / n), F.log1p(F.col("n_symbols") * 100 / n), F.log1p(F.col("n_dup_lines").cast("double")),
              F.log1p(F.col("n_repeat_words") * 100 / n)]
    return [F.floor(v * SCALE + 0.5).cast("long").alias(f"x{j}") for j, v in enumerate(values)]


def _moments() -> list[Column]:
    x = [F.col(f"x{j}") for j in range(DIMS)]
    return [F.count("*").alias("k"), *[F.sum(x[j]).alias(f"s{j}") for j in range(DIMS)], *[F.sum(x[j] * x[k]).alias(f"s{j}{k}") for j, k in PAIRS]]


def _centre_and_shape(sums: DataFrame, factor: float, *keep) -> DataFrame:
    """Means ``m`` and covariances ``c`` from sums; the floors are added to the variances."""
    k = F.col("k").cast("double")
    mean = [F.col(f"s{j}") / k / SCALE for j in range(DIMS)]
    cov = [((F.col(f"s{j}{i}") / k - F.col(f"s{j}") / k * (F.col(f"s{i}") / k)) / SCALE**2 * factor + (FLOORS[j] ** 2 if i == j else 0.0)) for j, i in PAIRS]
    return sums.select(*keep, *[m.alias(f"m{j}") for j, m in enumerate(mean)], *[c.alias(f"c{j}{i}") for (j, i), c in zip(PAIRS, cov, strict=True)])


def _cholesky(params: DataFrame, *keep) -> DataFrame:
    """Lower factor ``l`` of the covariances, and the logarithm of their determinant."""
    for j in range(DIMS):
        for i in range(j + 1):
            rest = F.col(f"c{j}{i}")
            for q in range(i):
                rest = rest - F.col(f"l{j}{q}") * F.col(f"l{i}{q}")
            params = params.withColumn(f"l{j}{i}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{i}{i}"))
    det = sum((F.log(F.col(f"l{j}{j}")) * 2 for j in range(DIMS)), F.lit(0.0))
    return params.select(*keep, *[f"m{j}" for j in range(DIMS)], *[f"l{j}{i}" for j, i in PAIRS], det.alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance ``d`` by forward substitution."""
    for j in range(DIMS):
        rest = F.col(f"x{j}") / SCALE - F.col(f"m{j}")
        for i in range(j):
            rest = rest - F.col(f"l{j}{i}") * F.col(f"z{i}")
        rows = rows.withColumn(f"z{j}", rest / F.col(f"l{j}{j}"))
    return rows.withColumn("d", sum((F.col(f"z{j}") ** 2 for j in range(DIMS)), F.lit(0.0)))


def _concentrated(rows: DataFrame) -> DataFrame:
    """Sums over the ``H`` nearest rows of each group and start, from ``grp, start, d`` and the statistics."""
    near = rows.withColumn("near", F.floor(F.log2(F.col("d") + 1e-3) * 16).cast("int"))
    counts = near.groupBy("grp", "start", "near").agg(F.count("*").alias("n"))
    every = Window.partitionBy("grp", "start")
    limits = (
        counts.withColumns({"upto": F.sum("n").over(every.orderBy("near")), "all": F.sum("n").over(every)})
        .filter(F.col("upto") >= F.col("all") * H).groupBy("grp", "start").agg(F.min("near").alias("limit"))
    )
    limits = cut(limits.withColumnsRenamed({"grp": "g", "start": "s"}))
    kept = near.join(limits, (F.col("grp") == F.col("g")) & (F.col("start") == F.col("s")) & (F.col("near") <= F.col("limit")))
    return kept.groupBy("grp", "start").agg(*_moments())


def _starts(rows: DataFrame) -> DataFrame:
    """Rows with the starting distances: from medians and median deviations, in three norms."""
    cells = spread(rows, F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("v")) for j in range(DIMS)]), "c", "grp")
    counts = cut(cells.groupBy("grp", "c.j", "c.v").agg(F.count("*").alias("n")))

    def middle(counts, value):
        every = Window.partitionBy("grp", "j")
        run = counts.withColumns({"upto": F.sum("n").over(every.orderBy(value)), "all": F.sum("n").over(every)})
        return run.filter(F.col("upto") * 2 >= F.col("all")).groupBy("grp", "j").agg(F.min(value).alias("mid"))

    med = cut(middle(counts, "v"))
    off = counts.join(med, ["grp", "j"]).groupBy("grp", "j", F.abs(F.col("v") - F.col("mid")).alias("off")).agg(F.sum("n").alias("n"))
    wide = med.join(middle(off, "off").withColumnRenamed("mid", "dev"), ["grp", "j"])
    pick = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c)))
    wide = cut(wide.groupBy("grp").agg(*[pick(c, j).alias(f"{c}{j}") for c in ("mid", "dev") for j in range(DIMS)]))
    z = [F.abs(F.col(f"x{j}") - F.col(f"mid{j}")) / F.greatest(F.col(f"dev{j}") * 1.4826, F.lit(FLOORS[j] * SCALE)) for j in range(DIMS)]
    norms = [sum((v * v for v in z), F.lit(0.0)), F.greatest(*z) ** 2, sum(z, F.lit(0.0)) ** 2]
    joined = rows.join(wide, "grp")
    return spread(joined, F.array(*[F.struct(F.lit(s).alias("start"), n.alias("d")) for s, n in enumerate(norms)]), "p", "grp", *[f"x{j}" for j in range(DIMS)]).select(
        "grp", *[f"x{j}" for j in range(DIMS)], "p.start", "p.d")


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor for each ``grp`` of ``rows`` (with the statistics ``x``); the group ``""`` is all rows."""
    xs = [f"x{j}" for j in range(DIMS)]
    both = cut(rows.select("grp", *xs).unionByName(rows.select(F.lit("").alias("grp"), *xs)))
    now = _concentrated(_starts(both))
    for _ in range(STEPS):
        params = cut(_cholesky(_centre_and_shape(now, CONSISTENT_H, "grp", "start"), "grp", "start"))
        now = _concentrated(_distance(both.join(params, "grp")))
    done = _cholesky(_centre_and_shape(now, CONSISTENT_H, "grp", "start"), "grp", "start")
    fields = [f"m{j}" for j in range(DIMS)] + [f"l{j}{i}" for j, i in PAIRS]
    best = cut(done.groupBy("grp").agg(F.min(F.struct("log_det", "start", *fields)).alias("b")).select("grp", *[F.col(f"b.{f}").alias(f) for f in fields]))
    sized = both.groupBy("grp").agg(F.count("*").alias("rows_in"))
    bulk = _distance(both.join(best, "grp")).filter(F.col("d") <= REWEIGHT).groupBy("grp").agg(*_moments())
    shaped = cut(_centre_and_shape(bulk, CONSISTENT_REWEIGHT, "grp").join(sized, "grp"))
    parts = [f"m{j}" for j in range(DIMS)] + [f"c{j}{i}" for j, i in PAIRS]
    every = shaped.filter("grp = ''").select(F.lit(True).alias("t"), *[F.col(p).alias(f"e_{p}") for p in parts])
    w = F.col("rows_in") / (F.col("rows_in") + F.lit(float(PRIOR)))
    joined = shaped.withColumn("t", F.lit(True)).join(every, "t").withColumn("w", F.when(F.col("grp") == "", 1.0).otherwise(w))
    w = F.col("w")
    apart = [F.col(f"m{j}") - F.col(f"e_m{j}") for j in range(DIMS)]
    blended = [(w * F.col(f"m{j}") + (1 - w) * F.col(f"e_m{j}")).alias(f"m{j}") for j in range(DIMS)]
    blended += [(w * F.col(f"c{j}{i}") + (1 - w) * F.col(f"e_c{j}{i}") + w * (1 - w) * apart[j] * apart[i]).alias(f"c{j}{i}") for j, i in PAIRS]
    return _cholesky(joined.select("grp", *blended), "grp")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` for every row.

    Null languages and sources are values of their own. A null text counts as empty and fails the base rule. Null and
    repeated ids and repeated rows are judged row by row, equal rows alike. ``distance`` is the squared distance.
    Other columns are left behind; an empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, lang_col, source_col).drop("_th", "_grp")


def _group(lang_col: str, source_col: str) -> Column:
    return F.to_json(F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")))


def _judged(docs, id_col, text_col, lang_col, source_col) -> DataFrame:
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), _group(lang_col, source_col).alias("grp"), F.col(text_col).alias("_text"))
    rows = cut(base_statistics(keyed, "_text", "_id", "_th", "grp").select("*", *_vector()))
    params = cut(estimates(rows))
    far = _distance(rows.join(params, "grp"))
    return far.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("d") <= CUTOFF)).alias("kept"), F.round("d", 6).alias("distance"), "_th", F.col("grp").alias("_grp"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rejected documents; all columns stay. Verdicts are found again by id and text, so texts are not shuffled but for suspects."""
    bad = cut(_judged(docs, id_col, text_col, lang_col, source_col).filter(~F.col("kept")).select(id_col, "_th", "_grp").distinct())
    keyed = docs.withColumns({"_th": F.xxhash64(text_col), "_grp": _group(lang_col, source_col)})
    return drop_keys(keyed, bad, [id_col, "_th", "_grp"]).drop("_th", "_grp")
