"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Base rules come first: a text fails with fewer than 20 words, or with more than 30 % of its words inside
8-word windows that occur twice or more.  For the others a vector of transformed statistics (``STATISTICS``) is
compared with its language and source: the minimum-covariance-determinant estimate holds the mean and
covariance of the documents that lie closest together, the ``CORE`` share of a language nearest to the estimates of their own
groups (so that a source of mostly junk is no core of its own).  It is sought by concentration steps from three
starts (medians and quartiles; mean and covariance of all; medians and a sphere): two steps from each, then the one of least
determinant goes on until the determinant falls no more (``MOST_STEPS``).  A document whose squared Mahalanobis distance,
scaled to a chi-square median and shrunk for the sampling noise of short texts, passes ``CUTOFF`` is rejected.

One law holds for groups of any size: a group's mean and covariance are shrunk to those of its language, and a
language's to those of all, as if each had ``PRIOR`` more documents of the wider kind.  The covariance has a floor on its
diagonal, as most texts have no symbols at all.

One pass a step: documents are counted by (group, distance bin) together with the sums of their statistics and
products, so the core's moments come from the bins below the core quantile, medians come from counts by bins as well, and no
group is ever gathered.  Everything is DataFrame expressions.

Defined cases: a null text has no words and fails; a very long text is measured whole; null lang and source are values of
their own; repeated rows all stay; without any document that passes the base rules nothing is estimated; an empty table gives
none; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm.text import whole, words
from loomql.plans.scratch import cut, small_side

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
CORE, MOST_STEPS, PRIOR = 0.75, 6, 100.0
STARTS = 3
FALL = 1e-3  # of the logarithm of a determinant; less is no fall
CUTOFF = 100.0
NOISE_WORDS = 30  # rates of a text of n words carry sampling noise; its distance counts n / (n + this)
BINS = 32  # a unit of ln(1 + distance)
#: Transformed statistics and the floors of their standard deviations.
STATISTICS = {"x_word_length": 0.1, "x_capitals": 0.02, "x_punctuation": 0.02, "x_symbols": 0.03, "x_repeated": 0.1}
GRID = {"x_word_length": 64}  # bins a unit for medians; 512 for rates
CHI2_MEDIAN = 4.3515  # five degrees of freedom


def _measured(docs: DataFrame) -> DataFrame:
    """Base columns and statistics of every row, each from whole texts."""
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.to_json(F.struct(F.col("lang").cast("string"), F.col("source").cast("string"))).alias("grp"), F.to_json(F.struct(F.col("lang").cast("string"))).alias("language")]
    rows = docs.select(*kept, whole(F.col("text")).alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "grp", "language",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z\x{C0}-\x{DE}]+", "")).alias("capitals"),
        F.length(F.regexp_replace("t", r"[^.,;:!?]+", "")).alias("punctuation"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("h", F.when(F.size("w") > WINDOW, windows)).drop("lines", "w")
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(repeated, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    twice = lambda x, k: (x["h"] == F.get(F.col("s"), k - 1)["h"]) | (x["h"] == F.get(F.col("s"), k + 1)["h"])
    places = F.array_sort(F.transform(F.filter("s", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("d", F.when(F.col("s").isNotNull(), places)).drop("s")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("d") - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get(F.col("d"), k) - F.get(F.col("d"), k - 1)))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("d").isNotNull(), covered), F.lit(0)).cast("long")).drop("d")
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    chars, n = F.greatest(F.lit(1), F.col("word_chars")), F.greatest(F.lit(1), F.col("n_words"))
    return rows.withColumns({
        "x_word_length": F.col("word_chars") / n,
        "x_capitals": F.sqrt(F.col("capitals") / chars),
        "x_punctuation": F.sqrt(F.col("punctuation") / chars),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_repeated": F.col("n_repeat_words") / n,
    }).drop("capitals", "punctuation")


def _cholesky(cov: list[list[Column]]) -> list[list[Column]]:
    """Lower factor of a symmetric matrix of columns."""
    p = len(cov)
    low: list[list[Column]] = [[F.lit(0.0)] * p for _ in range(p)]
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
    return low


_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _moments() -> list[Column]:
    names = list(STATISTICS)
    return [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i, j in _PAIRS]


def _shrunk(moments: DataFrame) -> DataFrame:
    """(language, grp, start, m0.., l00.., logdet) from (language, grp, start, n, s0.., q00..): means and Cholesky factors."""
    floors = list(STATISTICS.values())
    within = moments.withColumns({f"w{i}{j}": F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.greatest(F.lit(1), F.col("n")) for i, j in _PAIRS})
    sums = lambda tag: [F.sum(c).alias(f"{tag}{c}") for c in ("n", *[f"s{i}" for i in range(_P)], *[f"w{i}{j}" for i, j in _PAIRS])]
    every = within.groupBy(F.col("start").alias("a_start")).agg(*sums("a"))  # one row a start
    tongue = within.groupBy(F.col("language").alias("l_language"), F.col("start").alias("l_start")).agg(*sums("l"))
    out = within.join(small_side(tongue), F.col("language").eqNullSafe(F.col("l_language")) & (F.col("start") == F.col("l_start"))).join(F.broadcast(every), F.col("start") == F.col("a_start"))
    toward = lambda own, n, wider: (own + PRIOR * wider) / (n + PRIOR)
    out = out.withColumns({f"m{i}": toward(F.col(f"ls{i}"), F.col("ln"), F.col(f"as{i}") / F.col("an")) for i in range(_P)})
    out = out.withColumns({f"m{i}": toward(F.col(f"s{i}"), F.col("n"), F.col(f"m{i}")) for i in range(_P)})
    tongues = {(i, j): toward(F.col(f"lw{i}{j}"), F.col("ln"), F.col(f"aw{i}{j}") / F.col("an")) for i, j in _PAIRS}
    cov = [[toward(F.col(f"w{max(i, j)}{min(i, j)}"), F.col("n"), tongues[max(i, j), min(i, j)]) + (floors[i] ** 2 if i == j else 0.0) for j in range(_P)] for i in range(_P)]
    low = _cholesky(cov)
    for j in range(_P):
        for i in range(j, _P):
            out = out.withColumn(f"l{i}{j}", low[i][j])
    return _with_determinant(out)


def _with_determinant(out: DataFrame) -> DataFrame:
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, _P)), F.log("l00")) * 2
    return out.select("language", "grp", "start", *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS], logdet.alias("logdet"))


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the estimate of the row's group and start (null without one)."""
    own = estimate.select(F.col("grp").alias("e_grp"), F.col("start").alias("e_start"), *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS])
    out = rows.join(small_side(own), (F.col("grp") == F.col("e_grp")) & (F.col("start") == F.col("e_start")), "left")
    names = list(STATISTICS)
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, _P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _quartiles(fit: DataFrame) -> DataFrame:
    """(language, grp, q0_0, q0_1, q0_2, ...): quartiles of each statistic, from counts by bins."""
    grid = [GRID.get(x, 512) for x in STATISTICS]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * grid[i]).cast("int").alias("bin")) for i, x in enumerate(STATISTICS)])).alias("c")
    counts = fit.select("language", "grp", cells).groupBy("language", "grp", "c.i", "c.bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp", "i")
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    at = lambda i, k: F.min(F.when((F.col("i") == i) & (4 * F.col("upto") >= (k + 1) * F.col("all")), (F.col("bin") + 0.5) / grid[i])).alias(f"q{i}_{k}")
    return upto.groupBy("language", "grp").agg(*[at(i, k) for i in range(_P) for k in range(3)])


def _starts(fit: DataFrame) -> DataFrame:
    """Three estimates a group: medians and quartile ranges; mean and covariance of all; medians and the floors' sphere."""
    floors = list(STATISTICS.values())
    quartiles = cut(_quartiles(fit))

    def diagonal(start: int, spread) -> DataFrame:
        low = [(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
        return _with_determinant(quartiles.select("language", "grp", F.lit(start).alias("start"), *[F.col(f"q{i}_1").alias(f"m{i}") for i in range(_P)], *low))

    whole = _shrunk(fit.groupBy("language", "grp").agg(F.count("*").alias("n"), *_moments()).withColumn("start", F.lit(1)))
    ranged = diagonal(0, lambda i: F.greatest(F.lit(floors[i]), (F.col(f"q{i}_2") - F.col(f"q{i}_0")) / 1.349))
    return cut(ranged.unionByName(whole).unionByName(diagonal(2, lambda i: F.lit(3 * floors[i]))))


def _concentrate(fit: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimates from the ``CORE`` share of each language nearest to the last ones."""
    binned = _distance(fit, estimate).withColumn("bin", F.floor(BINS * F.log1p("d2")).cast("int"))
    bins = binned.groupBy("language", "grp", "start", "bin").agg(F.count("*").alias("n"), *_moments())
    bins = cut(bins)
    by = Window.partitionBy("language", "start")  # over bins, whose number doesn't grow
    counts = bins.groupBy("language", "start", "bin").agg(F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = counts.withColumn("below", below).withColumn("all", F.sum("n").over(by)).where(F.col("below") < CORE * F.col("all"))
    last = core.groupBy(F.col("language").alias("c_language"), F.col("start").alias("c_start")).agg(F.max("bin").alias("last"))
    held = bins.join(small_side(last), F.col("language").eqNullSafe(F.col("c_language")) & (F.col("start") == F.col("c_start")))
    names = ("n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS])
    inside = lambda c: F.sum(F.when(F.col("bin") <= F.col("last"), F.col(c)).otherwise(0)).alias(c)
    return cut(_shrunk(held.groupBy("language", "grp", "start").agg(*[inside(c) for c in names])))


def estimates(fit: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(language, grp, start, mean, covariance factor, logdet): the estimate of least determinant for each group of ``fit`` (columns ``language``, ``grp`` and ``STATISTICS``)."""
    many = fit.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    estimate = _starts(fit)
    for _ in range(2):
        estimate = _concentrate(many, estimate)
    best = estimate.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select(F.col("grp").alias("b_grp"), F.col("b.start").alias("b_start"))
    estimate = cut(estimate.join(best, (F.col("grp") == F.col("b_grp")) & (F.col("start") == F.col("b_start"))).drop("b_grp", "b_start", "start").withColumn("start", F.lit(0)))
    one = fit.withColumn("start", F.lit(0))
    for _ in range(most - 2):
        new = _concentrate(one, estimate)
        fall = new.select("grp", F.col("logdet").alias("now")).join(estimate.select("grp", "logdet"), "grp").agg(F.max(F.col("logdet") - F.col("now"))).first()[0]
        if fall is None or fall < FALL:
            break
        estimate = new
    return estimate


def _scales(fit: DataFrame, estimate: DataFrame) -> DataFrame:
    """(s_grp, scale): the median squared distance over that of chi-square, shrunk to 1 for few documents."""
    bins = _distance(fit.withColumn("start", F.lit(0)), estimate).groupBy("grp", F.floor(BINS * F.log1p("d2")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp")
    upto = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    median = F.min(F.when(2 * F.col("upto") >= F.col("all"), F.expm1((F.col("bin") + 0.5) / BINS)))
    n = F.max("all")
    return upto.groupBy(F.col("grp").alias("s_grp")).agg(F.exp(n * F.log(F.greatest(median, F.lit(1e-6)) / CHI2_MEDIAN) / (n + PRIOR)).alias("scale"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row of ``docs``.

    ``distance`` is the scaled squared Mahalanobis distance; null where the base rules fail.
    """
    rows = cut(_measured(docs))
    fit = rows.where("not base_failed").select("language", "grp", *STATISTICS)
    estimate = estimates(fit)
    scale = cut(_scales(fit, estimate))
    judged = _distance(rows.withColumn("start", F.lit(0)), estimate).join(small_side(scale), F.col("grp") == F.col("s_grp"), "left")
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.greatest(F.col("scale"), F.lit(0.2)) * F.col("n_words") / (F.col("n_words") + NOISE_WORDS))
    out = judged.withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_outliers(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
