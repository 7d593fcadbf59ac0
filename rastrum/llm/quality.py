"""Quality rules: base limits and robust multivariate outliers per language and source.

Each text becomes a vector of five transformed statistics.  For each group of
language and source the minimum covariance determinant estimate is sought: the
centre and covariance of that share COVERAGE of the rows whose covariance has the
least determinant.  It begins at three fixed starts (medians with quartile ranges,
signs of the vectors about the medians, correlation of squashed values); from each,
concentration steps take the rows of least Mahalanobis distance and estimate again,
which lowers the determinant, until no group's falls any more.  Of a group's starts
the one with the least determinant stays.  A text is rejected if its distance to its
group's estimate is beyond a cut-off.  Groups too small for an estimate are judged
by that of their language, and where that is too small as well, of all documents.

Everything is sums by group: a step sums rows up by fine logarithmic bins of
distance, so a group that holds a third of all rows is summed up in every task
before anything is shuffled, and picks bins from the sums.  Estimates are a few rows
per group; they are broadcast while their number is below a checked bound and joined
by salted keys beyond it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.llm.common import SPACE_CLASS, cut, let, words_of, written

DIMS = 5
COVERAGE = 0.75
#: Concentration steps at most; and a fall of the logarithm of a determinant that counts as none.
STEPS, STILL = 12, 1e-4
#: Rows that a group needs for an estimate of its own.
MIN_ROWS = 100
#: Variances are raised by the squares of these, so that spreads smaller than what a
#: word or a symbol more makes don't decide: log words, log word length, the angle of
#: the share of symbols, a quarter of log equal lines, and the angle of repeated words.
FLOORS = (0.25, 0.05, 0.05, 0.10, 0.10)
#: Median of chi-squared with five degrees of freedom.
CHI2_MEDIAN = 4.35146
#: Share of texts of a normal group that is rejected in error.
ERROR = 1e-7
#: Estimates to broadcast at most; a row has some 300 bytes.
BROADCAST_ROWS = 20_000
SALTS = 32
WINDOW = 8
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cutoff(error: float) -> float:
    """The value that chi-squared with five degrees of freedom exceeds with this chance, by halving."""
    tail = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > error else (low, middle)
    return high


#: Squared distance beyond which a text is rejected.
CUTOFF = chi2_cutoff(ERROR)


def repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that the text has twice or more.

    Windows are compared by hash within one text; only a text with equal windows is
    looked at closer: its windows are sorted by hash, those with an equal neighbour
    are kept, and each adds the words up to the next one's start.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def covered(h: Column) -> Column:
        windows = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(spread(w)))

    def spread(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda o: F.filter(o, lambda s, k: (F.get(o, k - 1)["h"] == s["h"]) | F.coalesce(F.get(o, k + 1)["h"] == s["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns STATS and base_failed; null and empty texts have no word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, SPACE_CLASS + "+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = words_of(F.col(text_col))
    out = docs.withColumns({"n_words": F.size(words).cast("long"), "word_chars": F.length(bare).cast("long"), "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), "n_repeat_words": let(words, repeat_words)})
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics: logarithms of sizes, variance-stabilising angles of shares."""
    angle = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    return [F.log(F.col("n_words") + 1.0), F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)), angle("n_symbols", "word_chars"), F.log(F.col("n_dup_lines") + 1.0) / 4, angle("n_repeat_words", "n_words")]


def group_key(lang_col: str, source_col: str) -> Column:
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    return F.concat(part(lang_col), F.lit("\x01"), part(source_col))


def attach(rows: DataFrame, estimates: DataFrame, n_estimates: int = 0, how: str = "left") -> DataFrame:
    """rows with each of their group's estimates (joined on grp)."""
    if n_estimates <= BROADCAST_ROWS:
        return rows.join(F.broadcast(estimates), "grp", how)
    salted = estimates.withColumn("_rs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_rs_salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "grp")), F.lit(SALTS)).cast("int")).join(salted, ["grp", "_rs_salt"], how).drop("_rs_salt")


def distance2() -> Column:
    """Squared Mahalanobis distance of v0.. to the attached estimate."""
    d = [F.col(f"v{i}") - F.col("center")[i] for i in range(DIMS)]
    terms = [(1 if i == j else 2) * F.col("inverse")[i * DIMS + j] * d[i] * d[j] for i in range(DIMS) for j in range(i, DIMS)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms))


def log_bin(value: Column) -> Column:
    return F.floor(16 * F.log2(value + 1e-6)).cast("int")


def inverted(moments: DataFrame) -> DataFrame:
    """grp, start, n, center, inverse and logdet from columns n, m0.. and c00.. (lower triangle), by Cholesky's factors."""
    at = lambda n, i, j: F.col(f"{n}{i}{j}")
    out = moments
    for j in range(DIMS):
        inner = [at("l", j, k) * at("l", j, k) for k in range(j)]
        pivot = at("c", j, j) + F.lit(FLOORS[j] ** 2) - sum(inner, F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1e-12))))
        out = out.withColumns({f"l{i}{j}": (at("c", i, j) - sum([at("l", i, k) * at("l", j, k) for k in range(j)], F.lit(0.0))) / at("l", j, j) for i in range(j + 1, DIMS)}) if j + 1 < DIMS else out
    for i in range(DIMS):
        out = out.withColumn(f"k{i}{i}", 1 / at("l", i, i))
        out = out.withColumns({f"k{i}{j}": -sum([at("l", i, k) * at("k", k, j) for k in range(j, i)], F.lit(0.0)) * at("k", i, i) for j in range(i)}) if i else out
    inverse = [sum([at("k", k, i) * at("k", k, j) for k in range(max(i, j), DIMS)], F.lit(0.0)) for i in range(DIMS) for j in range(DIMS)]
    logdet = 2 * sum([F.log(at("l", j, j)) for j in range(DIMS)], F.lit(0.0))
    return out.select("grp", "start", "n", F.array(*(F.col(f"m{i}") for i in range(DIMS))).alias("center"), F.array(*inverse).alias("inverse"), logdet.alias("logdet"))


def _lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def first_estimates(vectors: DataFrame) -> DataFrame:
    """The three starts of each grp."""
    grid = 64
    long = vectors.select("grp", F.posexplode(F.array(*(F.floor(F.col(f"v{i}") * grid).cast("int") for i in range(DIMS)))).alias("dim", "bin"))
    counts = long.groupBy("grp", "dim", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp", "dim")
    run = counts.select("grp", "dim", "bin", F.sum("c").over(w.orderBy("bin")).alias("upto"), F.sum("c").over(w).alias("all"))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    spread = run.groupBy("grp", "dim").agg(quantile(0.25).alias("low"), quantile(0.5).alias("mid"), quantile(0.75).alias("high"))
    one = lambda i, value: F.max(F.when(F.col("dim") == i, value))
    middle = [one(i, (F.col("mid") + 0.5) / grid).alias(f"m{i}") for i in range(DIMS)]
    width = [F.greatest(one(i, (F.col("high") - F.col("low")) / (1.349 * grid)), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(DIMS)]
    robust = spread.groupBy("grp").agg(*middle, *width)
    robust = cut(robust)
    groups = robust.count()
    z = [(F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(DIMS)]
    scaled = attach(vectors, robust, groups, "inner").select("grp", *(f"m{i}" for i in range(DIMS)), *(f"s{i}" for i in range(DIMS)), *(x.alias(f"z{i}") for i, x in enumerate(z)))
    length = F.greatest(F.sqrt(sum([F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)], F.lit(0.0))), F.lit(1e-9))
    scaled = scaled.withColumns({"length": length, **{f"t{i}": F.tanh(f"z{i}") for i in range(DIMS)}})
    fixed = [F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ms" for i in range(DIMS)]
    signs = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("length") * F.col("length"))).alias(f"g{i}{j}") for i, j in _lower()]
    squashed = [F.covar_pop(f"t{i}", f"t{j}").alias(f"h{i}{j}") for i, j in _lower()]
    sums = scaled.groupBy("grp").agg(*fixed, *signs, *squashed)
    scale = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    shapes = [
        {(i, j): scale(i, j) if i == j else F.lit(0.0) for i, j in _lower()},
        {(i, j): DIMS * scale(i, j) * F.col(f"g{i}{j}") for i, j in _lower()},
        {(i, j): scale(i, j) * F.col(f"h{i}{j}") / F.greatest(F.sqrt(F.col(f"h{i}{i}") * F.col(f"h{j}{j}")), F.lit(1e-6)) for i, j in _lower()},
    ]
    starts = F.array(*(F.struct(F.lit(k).alias("start"), *(x.cast("double").alias(f"c{i}{j}") for (i, j), x in shape.items())) for k, shape in enumerate(shapes)))
    moments = sums.select("grp", F.lit(0).cast("long").alias("n"), *(f"m{i}" for i in range(DIMS)), F.explode(starts).alias("begun"))
    return inverted(moments.select("grp", "n", *(f"m{i}" for i in range(DIMS)), "begun.*"))


def concentrated(vectors: DataFrame, now: DataFrame, groups: int) -> DataFrame:
    """One step: the estimate of the share COVERAGE of a group's rows that are nearest to each of its estimates, with the fall of logdet."""
    d = [F.col(f"v{i}") - F.col("center")[i] for i in range(DIMS)]
    rows = attach(vectors, now, groups, "inner").select("grp", "start", log_bin(distance2()).alias("bin"), *(x.alias(f"d{i}") for i, x in enumerate(d)))
    sums = [F.sum(f"d{i}").alias(f"a{i}") for i in range(DIMS)] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}{j}") for i, j in _lower()]
    bins = rows.groupBy("grp", "start", "bin").agg(F.count("*").alias("c"), *sums)
    w = Window.partitionBy("grp", "start")
    near = bins.withColumns({"before": F.sum("c").over(w.orderBy("bin")) - F.col("c"), "all": F.sum("c").over(w)}).where(F.col("before") < COVERAGE * F.col("all"))
    total = near.groupBy("grp", "start").agg(F.sum("c").alias("n"), *(F.sum(c).alias(c) for c in [f"a{i}" for i in range(DIMS)] + [f"q{i}{j}" for i, j in _lower()]))
    old = now.select("grp", "start", F.col("center").alias("old"), F.col("logdet").alias("was"))
    total = total.join(old, ["grp", "start"])
    mean = lambda i: F.col(f"a{i}") / F.col("n")
    moments = total.select("grp", "start", "n", *((F.col("old")[i] + mean(i)).alias(f"m{i}") for i in range(DIMS)), *((F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _lower()))
    return inverted(moments).join(old.select("grp", "start", "was"), ["grp", "start"])


def estimates_of(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Per grp of vectors (grp, v0..v4): center, inverse, n and logdet of the start that ends with the least determinant; and the number of groups.

    The inverse is scaled so that the median distance is no larger than a normal vector's.
    """
    now = cut(first_estimates(vectors))
    groups = now.count()
    for number in range(STEPS):
        now = cut(concentrated(vectors, now, groups))
        fall = now.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        if number and (fall is None or fall < STILL):
            break
    best = cut(now.groupBy("grp").agg(F.min_by(F.struct("n", "center", "inverse", "logdet"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*"))
    bins = attach(vectors, best, groups, "inner").select("grp", log_bin(distance2()).alias("bin")).groupBy("grp", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp")
    upto = bins.select("grp", "bin", F.sum("c").over(w.orderBy("bin")).alias("upto"), F.sum("c").over(w).alias("all"))
    middle = upto.where(F.col("upto") >= 0.5 * F.col("all")).groupBy("grp").agg(F.min("bin").alias("mid"))
    median = F.pow(F.lit(2.0), (F.col("mid") + 0.5) / 16)
    scaled = best.join(middle, "grp").select("grp", "n", "logdet", "center", F.transform("inverse", lambda x: x * F.lit(CHI2_MEDIAN) / F.greatest(median, F.lit(CHI2_MEDIAN))).alias("inverse"))
    return cut(scaled), groups


def judged(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Adds distance2 (double) and kept (boolean) to rows that have STATS, base_failed, lang and source.

    A group of fewer than MIN_ROWS rows is judged by the estimate of its language,
    over all sources, or, if that has fewer as well, by that of all rows.  A table
    of fewer than MIN_ROWS rows that pass the base limits has no estimate: distances
    are null, and only the base limits decide.  Null languages and sources are values of
    their own.  Texts that failed the base limits don't enter estimates.  Rows that
    repeat count each; an empty table gives an empty one.  stats is read several
    times and should have been written.
    """
    both = lambda rows: rows.select(F.array(group_key(lang_col, source_col), F.concat(F.substring_index(group_key(lang_col, source_col), "\x01", 1), F.lit("\x01*")), F.lit("*")).alias("grps"), *(x.alias(f"v{i}") for i, x in enumerate(vector())))
    fit = both(stats.where(~F.col("base_failed")))
    sizes = cut(fit.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count("*").alias("rows")))
    large = cut(sizes.where(F.col("rows") >= MIN_ROWS).select("grp"))
    n_groups = sizes.count()
    lang = sizes.where(F.col("grp").contains("\x01") & ~F.col("grp").endswith("\x01*")).select("grp", F.concat(F.substring_index("grp", "\x01", 1), F.lit("\x01*")).alias("wide"))
    own = lang.join(large.select("grp", F.col("grp").alias("first")), "grp", "left").join(large.select(F.col("grp").alias("wide"), F.col("grp").alias("second")), "wide", "left")
    target = cut(own.select("grp", F.coalesce("first", "second", F.lit("*")).alias("own")))
    used = cut(target.select(F.col("own").alias("grp")).distinct().join(large, "grp"))
    vectors = cut(attach(fit.select(F.explode("grps").alias("grp"), *(f"v{i}" for i in range(DIMS))), used.withColumn("known", F.lit(True)), n_groups, "inner").drop("known"))
    estimates, n_estimates = estimates_of(vectors)
    rows = stats.withColumns({"grp": group_key(lang_col, source_col)} | {f"v{i}": x for i, x in enumerate(vector())})
    rows = attach(attach_own(rows, target, n_groups), estimates, n_estimates)
    rows = rows.withColumn("distance2", F.when(F.col("center").isNotNull(), distance2()))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > cutoff, F.lit(False))
    return rows.withColumn("kept", kept).select(*(c for c in stats.columns if c not in ("distance2", "kept")), "distance2", "kept")


def attach_own(rows: DataFrame, target: DataFrame, n_groups: int) -> DataFrame:
    """Replaces grp by the group that judges it; one that no row passed the base limits of is judged by all rows' estimate."""
    return attach(rows, target, n_groups).withColumn("grp", F.coalesce("own", F.lit("*"))).drop("own")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, STATS, base_failed, distance2 and kept per row; the statistics are written once and read for each step.

    Null and empty texts have no word and fail the base limits.  Very long texts are
    split whole in their row.  Other columns are not looked at; ``judged`` says the rest.
    """
    few = docs.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judged(written(with_stats(few).drop("text"))).drop("lang", "source")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with docs' columns; rows are written once with their statistics and texts aren't shuffled."""
    own = docs.select(F.struct("*").alias("_rs_row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judged(written(with_stats(own).drop("text"))).where("kept").select("_rs_row.*")
