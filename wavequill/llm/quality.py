"""Quality rules: counts of whole texts, then robust multivariate outliers by language and source.

The outliers are found by the minimum covariance determinant: from several starts, concentration steps keep the share H of a
group's documents that lie nearest, and estimate centre and covariance anew from them: two from each start, and more from the
one with the least determinant, until that falls no further. A group's estimates are shrunk towards those of its language, and these towards those of
all documents, as if so many documents of the wider group were among its own; so a group of one is judged like one of many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, small, split_words, stage, text_of, unstage

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that the estimates rest on; concentration steps at most (fewer, once no determinant changes); documents of
#: the wider group that a group's own estimates are mixed with.
H, STEPS, PRIOR = 0.75, 20, 30
#: By how much less the determinant's logarithm has to become for another step.
LEAST_FALL = 1e-4
#: Squared distance beyond which a document is rejected. The median of chi-squared with 5 degrees is 4.3515.
CUTOFF, CHI2_MEDIAN = 40.0, 4.3515
#: Statistics are rounded to 1/SCALE, so that their sums are whole numbers and the order of rows doesn't matter.
SCALE = 1024
#: Transformed statistics, and the standard deviation each is given at least: most texts have no symbol or repeated line.
FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
FLOOR = (0.25, 0.05, 0.04, 0.2, 0.2)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of docs' whole texts.

    A window is known by a 64-bit hash of its three words. Only texts with a repeated window sort their windows.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", "lang", "source", split_words(text).alias("words"), F.length(F.regexp_replace(text, SPACE, "")).alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), lines.alias("lines"))
    keep = ["doc_id", "lang", "source", "word_chars", "n_symbols"]
    window = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    hashed = base.select(*keep, F.size("words").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.when(F.size("words") >= 3, window).alias("g"))
    at = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    keep += ["n_words", "n_lines", "n_dup_lines"]
    ordered = hashed.select(*keep, F.when(F.size("g") > F.size(F.array_distinct("g")), at).alias("s"))
    twice = F.filter("s", lambda x, i: x["h"].eqNullSafe(F.get("s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("s", i + 1)["h"]))
    places = ordered.select(*keep, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    reach = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3))))
    repeat = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0))
    out = places.select(*keep, repeat.alias("n_repeat_words"))
    return out.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def _features() -> list[Column]:
    n, chars = F.col("n_words") + 1.0, F.col("word_chars") + 1.0
    raw = (F.ln(n), F.ln(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1.0)), F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(x * SCALE).cast("long").alias(f) for x, f in zip(raw, FEATURES)]


def _factors(params: DataFrame) -> DataFrame:
    """params (m0.., c00..) with the inverse of the covariance's Cholesky factor, in steps so that no expression is repeated."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            left = F.col(f"c{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                params = params.withColumn(f"v{i}{j}", 1.0 / F.col(f"l{i}{i}"))
            else:
                left = sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))
                params = params.withColumn(f"v{i}{j}", -left / F.col(f"l{i}{i}"))
    return params


def _with_det(params: DataFrame) -> DataFrame:
    """params with the factors and the determinant's logarithm."""
    p = len(FEATURES)
    return _factors(params).withColumn("logdet", sum((2 * F.ln(f"l{i}{i}") for i in range(p)), F.lit(0.0))).drop(*[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    d2 = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = sum(((F.col(FEATURES[j]) / SCALE - F.col(f"m{j}")) * F.col(f"v{i}{j}") for j in range(i + 1)), F.lit(0.0))
        d2 = d2 + z * z
    return d2


def _level(d2: Column) -> Column:
    """Distances in steps of about 1.5 %: few different values, so that documents are ranked by counts of them."""
    return F.round(64 * F.ln(1 + d2)).cast("long")


def _sums() -> list[Column]:
    """Sums of whole numbers, so that the order of rows doesn't matter."""
    p, big = len(FEATURES), lambda c: c.cast("decimal(20,0)")
    sums = [F.count("*").alias("n")] + [F.sum(big(F.col(f))).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    return sums + [F.sum(big(F.col(FEATURES[i]) * F.col(FEATURES[j]))).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]


def _moments(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, m.., c..: centre and covariance (with the floor) of frames with the columns of _sums()."""
    p = len(FEATURES)
    mean = lambda i: F.col(f"s{i}").cast("double") / F.col("n") / SCALE
    cov = [(F.col(f"q{i}{j}").cast("double") / F.col("n") / SCALE**2 - mean(i) * mean(j) + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return found.select(*keys, "n", *[mean(i).alias(f"m{i}") for i in range(p)], *cov)


def _nearest(stats: DataFrame, params: DataFrame) -> DataFrame:
    """grp, start, n, m.., c..: estimates anew, from the levels of distance that hold the nearest share H of each group.

    Rows are added up by level first, so a group of any size is some hundred sums before they are brought together.
    """
    names = [c for c in params.columns if c[0] in "mv"]
    near = stats.join(small(params.select("grp", "start", *names), bound=50_000), "grp").select("grp", "start", _level(_distance()).alias("level"), *FEATURES)
    of_level = near.groupBy("grp", "start", "level").agg(*_sums())
    upto = Window.partitionBy("grp", "start").orderBy("level")
    counted = of_level.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("grp", "start")))
    inner = counted.where(F.col("before") < H * F.col("total"))
    columns = [c for c in of_level.columns if c not in ("grp", "start", "level")]
    return _moments(inner.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in columns]), ["grp", "start"])


def _starts(stats: DataFrame) -> DataFrame:
    """grp, start, m.., c..: medians with the spread of each statistic alone (0), medians with the floors (1), and all rows (2)."""
    p = len(FEATURES)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    mid = stage(stats.groupBy("grp").agg(*[F.percentile(f, 0.5).alias(f"_{i}") for i, f in enumerate(FEATURES)]), "medians")
    off = stats.join(small(mid, bound=50_000), "grp").groupBy("grp").agg(*[F.first(f"_{i}").alias(f"_{i}") for i in range(p)], *[F.percentile(F.abs(F.col(f) - F.col(f"_{i}")), 0.5).alias(f"a{i}") for i, f in enumerate(FEATURES)])
    centre = [(F.col(f"_{i}") / SCALE).alias(f"m{i}") for i in range(p)]
    spread = lambda i: F.pow(F.col(f"a{i}") / SCALE * 1.4826, F.lit(2.0)) + FLOOR[i] ** 2
    alone = off.select("grp", F.lit(0).alias("start"), *centre, *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in cells])
    floors = mid.select("grp", F.lit(1).alias("start"), *centre, *[F.lit(FLOOR[i] ** 2 if i == j else 0.0).alias(f"c{i}{j}") for i, j in cells])
    whole = _moments(stats.groupBy("grp").agg(*_sums()), ["grp"]).withColumn("start", F.lit(2))
    return alone.unionByName(floors).unionByName(whole.select(alone.columns))


def estimates(stats: DataFrame) -> DataFrame:
    """grp, n, m.., c.., lnscale: the minimum covariance determinant estimates of each group.

    stats: grp and FEATURES (whole numbers). exp(lnscale) brings the median distance to that of chi-squared, and is 1 at least.
    """
    p = len(FEATURES)
    columns = [*[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i in range(p) for j in range(i + 1)]]
    row = ["logdet", *columns, *[f"v{i}{j}" for i in range(p) for j in range(i + 1)]]
    begin = stage(_factors(_starts(stats)), "estimates")
    params = stage(_with_det(_nearest(stats, begin)), "estimates")
    unstage(begin)
    for i in range(STEPS):
        after = _with_det(_nearest(stats, params)).select("grp", "start", F.struct(*row).alias("after"))
        before = params.select("grp", "start", F.struct(*row).alias("before"))
        both = after.join(small(before, bound=50_000), ["grp", "start"])
        fell = (F.col("before.logdet") - F.col("after.logdet") > LEAST_FALL).alias("fell")
        both = both.select("grp", "start", fell, F.least("before", "after").alias("b"))
        if i == 0:  # only the best start of each group goes on
            both = both.groupBy("grp").agg(F.min(F.struct("b", "start", "fell")).alias("s")).select("grp", "s.start", "s.fell", "s.b")
        later = stage(both.select("grp", "start", "fell", "b.*"), "estimates")
        unstage(params)
        params = later
        if not params.where("fell").limit(1).count():
            break
    best = params.select("grp", *row[1:])
    best = stage(best, "estimates")
    names = [c for c in best.columns if c[0] in "mv"]
    mid = stats.join(small(best.select("grp", *names), bound=50_000), "grp").groupBy("grp").agg(F.percentile(_level(_distance()), 0.5).alias("mid"), F.count("*").alias("n"))
    lnscale = F.ln(F.greatest(F.lit(1.0), (F.exp(F.col("mid") / 64) - 1) / CHI2_MEDIAN))
    out = stage(best.join(mid, "grp").select("grp", "n", *columns, lnscale.alias("lnscale")), "estimates")
    unstage(params, best)
    return out


def _shrunk(own: DataFrame, wide: DataFrame) -> DataFrame:
    """own (grp, up, n, m.., c.., lnscale), each mixed with PRIOR documents' worth of the estimates of wide whose grp is up."""
    names = [c for c in own.columns if c not in ("grp", "up", "n")]
    theirs = wide.select(F.col("grp").alias("_up"), *[F.col(c).alias(f"_{c}") for c in names])
    mixed = [((F.col("n") * F.col(c) + PRIOR * F.col(f"_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in names]
    return own.join(small(theirs, bound=50_000), F.col("up") == F.col("_up")).select("grp", *mixed)


def _grp(level: int) -> Column:
    """The group of a row at a level: 0 all documents, 1 its language, 2 its language and source."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c) for c in ("lang", "source")[:level]]), {"ignoreNullFields": "false"})


def _parameters(featured: DataFrame) -> DataFrame:
    """grp, m.., v.., lnscale of every group of language and source in featured (lang, source, FEATURES), shrunk."""
    stats = featured.select(F.explode(F.array(*[_grp(k) for k in range(3)])).alias("grp"), *FEATURES)
    found = estimates(stats)
    groups = stage(featured.select(_grp(0).alias("all"), _grp(1).alias("lang"), _grp(2).alias("grp")).distinct(), "groups")
    langs = groups.select(F.col("lang").alias("grp"), F.col("all").alias("up")).distinct()
    langs = stage(_shrunk(found.join(small(langs, bound=50_000), "grp"), found), "estimates")
    own = _shrunk(found.join(small(groups.select("grp", F.col("lang").alias("up")), bound=50_000), "grp"), langs)
    return stage(_factors(own).select("grp", "lnscale", *[f"m{i}" for i in range(len(FEATURES))], *[f"v{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]), "estimates")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance, kept for every row of docs (doc_id, text, lang, source).

    Null texts have no words, and fail the base like any of fewer than MIN_WORDS. Null languages and sources make groups of
    their own. Every document has a distance, whatever its group's size: see _shrunk(). Repeated rows count as often as they
    are there; equal rows get equal verdicts. Empty tables give no rows. Other columns are not read.
    """
    counted = stage(counts(docs.select("doc_id", "text", "lang", "source")), "counts")
    featured = counted.select("*", _grp(2).alias("grp"), *_features())
    params = _parameters(counted.select("lang", "source", *_features())).withColumnRenamed("grp", "_grp")
    joined = featured.join(small(params, bound=50_000), F.col("grp") == F.col("_grp"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (_distance() / F.exp("lnscale")).alias("distance"))
    return out.select("*", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
