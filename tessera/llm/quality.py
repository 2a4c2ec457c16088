"""Quality rules and robust multivariate outliers, in DataFrame functions alone.

Fixed rules come first: a document of fewer than 10 words, or with more than a
fifth of its words in repeated five-word windows, fails. The others' statistics
are transformed to a vector; for each language and source a minimum covariance
determinant (MCD) estimate gives centre and scatter of its densest three
quarters, and a document far from its group by Mahalanobis distance is
rejected.

MCD: two fixed starts per group (medians with quartile ranges, and plain
moments) take C-steps (keep the share `inside` of rows nearest by the current
estimate, estimate anew from those), and the start with the smaller
determinant stays. Each step is a grouped sum over the stored statistics; the
distance within which the share lies comes from a histogram of distances, so
no group meets in one task. Floors added to the variances keep groups regular
whose ratios are all zero. Groups of fewer than `least` rows share one estimate
per language, from those groups' rows; where these are too few as well, the
rest shares one. If even that has fewer than `least` rows, its documents have
no estimate and pass the outlier test.

Contract: a null text has no words (and fails). Null languages and sources are
groups of their own. Each input row gives one output row, rows with equal ids
included. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import column, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
DIMS = ("x1", "x2", "x3", "x4")
#: Standard deviations added to each dimension's estimate: length of words (log), symbols (log), repeated lines, repeated words.
FLOORS = (0.08, 0.25, 0.1, 0.06)
#: Squared distances beyond this are outliers: the chi-square quantile of 4 degrees at 1 - 1e-6.
CUTOFF = 33.38
#: For normal data, the covariance of the nearest three quarters times this is consistent (4 dimensions).
CONSISTENT = 1.43


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(h: Column, body) -> Column:
    """body(hash of each five-word window), from word hashes h of at least five words."""
    pair = lambda x, y: F.xxhash64(x, y)
    shifted = lambda x, k, n: F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1) + k, n), pair)
    of_five = lambda four: F.zip_with(four, F.slice(h, F.lit(WINDOW), F.size(four)), pair)
    cut = lambda four: F.slice(four, F.lit(1), F.size(h) - 4)
    return let(shifted(h, 1, F.size(h) - 1), lambda two: let(shifted(two, 2, F.size(two) - 2), lambda four: let(of_five(cut(four)), body)))


def _covered(g: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""

    def of_places(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) & (i > 0) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), of_places)

    rows = F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(rows), of_sorted))


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_full_lines under the prefix. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank_free = F.length(F.translate(text, BLANKS, ""))
    repeated = lambda h: F.when(F.size(h) < WINDOW + 1, F.lit(0)).otherwise(_windows(h, _covered))
    of_words = let(F.transform(words_of(text), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), repeated(h).alias("r")))
    of_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    w, x = f"{prefix}_w", f"{prefix}_l"
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    out = docs.withColumns({w: of_words, x: of_lines, f"{prefix}word_chars": blank_free.cast("long"), f"{prefix}n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    out = out.withColumns({f"{prefix}n_words": F.col(w)["n"].cast("long"), f"{prefix}n_repeat_words": F.col(w)["r"].cast("long"), f"{prefix}n_full_lines": F.col(x)["n"].cast("long"), f"{prefix}n_dup_lines": F.col(x)["d"].cast("long")}).drop(w, x)
    return out.withColumn(f"{prefix}base_failed", (n < 10) | (100 * r > 20 * n))


def vector(prefix: str = "") -> dict[str, Column]:
    """The transformed statistics."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    return {
        f"{prefix}x1": F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        f"{prefix}x2": F.log1p(100 * c("n_symbols") / (c("word_chars") + 1)),
        f"{prefix}x3": c("n_dup_lines") / (c("n_full_lines") + 3),
        f"{prefix}x4": c("n_repeat_words") / (c("n_words") + 1),
    }


def _moments(prefix: str = "") -> list[Column]:
    pairs = [(a, b) for k, a in enumerate(DIMS) for b in DIMS[: k + 1]]
    return [*(F.avg(a).alias(f"m_{a}") for a in DIMS), *(F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs)]


def _factored(model: DataFrame, scale: float) -> DataFrame:
    """Adds the Cholesky factor l_ij of scale * covariance + floors, and the log of its determinant."""
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            s = scale * F.col(f"c_{a}{b}") - sum((F.col(f"l_{a}{x}") * F.col(f"l_{b}{x}") for x in DIMS[:j]), F.lit(0.0))
            model = model.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(s + FLOORS[i] ** 2, F.lit(FLOORS[i] ** 2 / 4))) if i == j else s / F.col(f"l_{b}{b}"))
    return model.withColumn("logdet", sum((F.log(F.col(f"l_{a}{a}")) for a in DIMS), F.lit(0.0)))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the vector columns by the model's columns."""
    z: list[Column] = []
    for i, a in enumerate(DIMS):
        z.append((F.col(f"{prefix}{a}") - F.col(f"m_{a}") - sum((F.col(f"l_{a}{b}") * z[j] for j, b in enumerate(DIMS[:i])), F.lit(0.0))) / F.col(f"l_{a}{a}"))
    return sum((x * x for x in z), F.lit(0.0))


def _plain_model(c: str) -> list[str]:
    return [c, *(f"m_{a}" for a in DIMS), *(f"l_{a}{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1])]


def _inside(rows: DataFrame, share: float) -> DataFrame:
    """key, start, most: the distance within which the share of each group's rows lies, from a histogram in steps of 1 %."""
    bins = rows.groupBy("key", "start", F.floor(F.log(F.col("d2") + 1e-4) * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("key", "start")
    upto = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    return upto.filter(F.col("upto") >= share * F.col("all")).groupBy("key", "start").agg(F.min("bin").alias("most"))


def fit(stats: DataFrame, steps: int = 3, least: int = 60, inside: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(levels, model): levels names the group that each language and source uses, model has its estimate.

    stats: stored rows with grp_lang, grp_source and the vector, of documents
    that passed the fixed rules.
    """
    counts = stats.groupBy("grp_lang", "grp_source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least
    pooled = counts.withColumn("small_n", F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("grp_lang")))
    key = F.when(~small, F.concat_ws("\x01", "grp_lang", "grp_source")).when(F.col("small_n") >= least, F.concat_ws("\x01", F.col("grp_lang"), F.lit("\x02"))).otherwise(F.lit("\x02"))
    levels = stored(pooled.select("grp_lang", "grp_source", key.alias("key")), "quality-levels")
    rows = stats.join(levels, ["grp_lang", "grp_source"]).select("key", *DIMS)
    quartiles = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(f"q_{a}") for a in DIMS))
    spread = lambda a: F.pow((F.get(F.col(f"q_{a}"), F.lit(2)) - F.get(F.col(f"q_{a}"), F.lit(0))) / 1.349, F.lit(2.0))
    robust = quartiles.select("key", F.lit(0).alias("start"), "n", *(F.get(F.col(f"q_{a}"), F.lit(1)).alias(f"m_{a}") for a in DIMS), *((spread(a) if a == b else F.lit(0.0)).alias(f"c_{a}{b}") for k, a in enumerate(DIMS) for b in DIMS[: k + 1]))
    plain = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *_moments()).withColumn("start", F.lit(1))
    model = stored(_factored(robust.unionByName(plain), 1.0), "quality-model")
    for _ in range(steps):
        by_model = rows.join(model.select("start", "n", *_plain_model("key")), "key").select("key", "start", "n", *DIMS, _distance().alias("d2"))
        near = by_model.join(_inside(by_model, inside), ["key", "start"]).filter(F.floor(F.log(F.col("d2") + 1e-4) * 100) <= F.col("most"))
        model = stored(_factored(near.groupBy("key", "start").agg(F.max("n").alias("n"), *_moments()), CONSISTENT), "quality-model")
    best = model.groupBy("key").agg(F.min_by(F.struct(*[c for c in model.columns if c != "key"]), F.struct("logdet", "start")).alias("m")).select("key", "m.*")
    return levels, stored(best.filter(F.col("n") >= least).select(*_plain_model("key")), "quality-best")


def _groups(lang_col: str, source_col: str) -> dict[str, Column]:
    return {"grp_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("\x03")), "grp_source": F.coalesce(F.col(source_col).cast("string"), F.lit("\x03"))}


def _verdict(rows: DataFrame, levels: DataFrame, model: DataFrame, prefix: str = "") -> DataFrame:
    """rows with `{prefix}kept`; rows of groups without an estimate pass."""
    # one row per group, written so that the planner knows its size and broadcasts it only if small
    used = stored(levels.join(model, "key").select("grp_lang", "grp_source", *_plain_model("key")).drop("key"), "quality-used")
    out = rows.join(used, ["grp_lang", "grp_source"], "left")
    near = F.coalesce(_distance(prefix) <= CUTOFF, F.lit(True))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & near).drop(*used.columns)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed and kept; one row per input row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in _groups(lang_col, source_col).items()))
    stats = stored(statistics(own).drop("text").withColumns(vector()), "quality")
    levels, model = fit(stats.filter(~F.col("base_failed")))
    return _verdict(stats, levels, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Statistics are computed again on the second scan, so texts are not
    shuffled: only the groups' estimates, one row per group, meet them.
    """
    columns, p = docs.columns, "_tq_"
    few = docs.select(F.col(text_col).alias("text"), *(c.alias(k) for k, c in _groups(lang_col, source_col).items()))
    stats = stored(statistics(few).drop("text").withColumns(vector()), "quality")
    levels, model = fit(stats.filter(~F.col("base_failed")))
    own = statistics(docs.select(*[column(c).alias(f"c{k}") for k, c in enumerate(columns)], *(c.alias(k) for k, c in _groups(lang_col, source_col).items())), f"c{columns.index(text_col)}", p).withColumns(vector(p))
    return _verdict(own, levels, model, p).filter(f"{p}kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
