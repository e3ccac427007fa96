"""Quality rules: robust multivariate outliers by the minimum covariance determinant (MCD).

Every document gets five counts from its whole text (``text_statistics``), a plain rule on two
of them (``base_failed``), and a vector of transformed statistics. For each (lang, source) the
MCD mean and covariance are estimated by concentration steps: keep the ``support`` share of
rows with the smallest Mahalanobis distance, estimate again, until no group's determinant falls any
further; then one reweighting step.
Rows beyond ``cutoff`` squared distance are rejected.

Only DataFrame functions. A group is never gathered: each step is one pass that adds up counts and
moments per logarithmic bucket of distances, written as finished sums, which are then cumulated up
to the support threshold. Group parameters are a small written table, joined to the rows (Spark broadcasts it
if its files are small; otherwise the join is a shuffle that AQE can split on a hot group).

Groups with fewer than ``min_rows`` rows are pooled per language, and if still too few, over all
languages; a pool that is too small even then rejects nothing.

Defined cases: null text counts as empty (no words: ``base_failed``); null lang or source is a
group of its own; repeated rows are judged alike; texts of any length are read whole; an empty table
gives an empty result; ``quality_filter`` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BLANKS, let, quote, stage, with_columns, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Dimensions of the statistic vector and the least standard deviation each is given: statistics
#: that are constant in a group (no symbols at all) must not make its covariance singular.
FLOORS = {"log_words": 0.5, "log_word_len": 0.1, "symbol_share": 0.1, "dup_share": 0.1, "repeat_share": 0.1}
DIMS = list(FLOORS)
P = len(DIMS)
#: Columns of a group's model: means and the inverse Cholesky factor, a lower triangle.
_PARAMETERS = [f"m{i}" for i in range(P)] + [f"w{i}{j}" for i in range(P) for j in range(i + 1)]
#: Variance of the central 75 % of a 5-dimensional normal is smaller than the whole's by this
#: factor: 0.75 / P(chi2_7 <= chi2_5's 0.75 quantile).
CONSISTENCY = 1.41
#: chi2_5 quantiles: 0.975 (reweighting) and 1 - 1e-5 (rejection).
REWEIGHT = 12.83
CUTOFF = 30.86
SUPPORT = 0.75
#: Fall of a log determinant (of the Cholesky factor) that counts as a step forward.
SETTLED = 1e-4
BUCKETS_PER_OCTAVE = 16


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Words covered by ``width``-word windows found twice or more.

    Windows are hashed; hash (high bits) and position (low bits, as many as the text needs) share
    one long, so that one primitive sort brings equal windows together. Neighbours in that order
    with equal hashes are compared word by word, so a hash collision never counts as a repeat.
    """

    def covered(pos: Column) -> Column:
        gaps = F.transform(pos, lambda p, k: F.least(F.lit(width).cast("long"), F.coalesce(F.get(pos, k + 1) - p, F.lit(width).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(w: Column, packed: Column, mask: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            at, other = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            equal = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0
            for d in range(width):
                equal = equal & (F.get(w, at + d) == F.get(w, other + d))
            return F.coalesce(equal, F.lit(False))

        hit = F.filter(packed, lambda x, j: same(x, F.get(packed, j - 1)) | same(x, F.get(packed, j + 1)))
        return let(F.array_sort(F.transform(hit, lambda x: x.bitwiseAND(mask))), covered)

    def of(w: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(w) + 1)).cast("int")) - 1

        def packed(m: Column) -> Column:
            hashes = F.transform(
                F.sequence(F.lit(0), F.size(w) - width),
                lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(width)]).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")),
            )
            return let(F.sort_array(hashes), lambda s: repeated(w, s, m))

        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(mask, packed))

    return let(words, of)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts (long) and ``base_failed`` to every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return with_columns(
        with_columns(
            docs,
            n_words=F.size(words_of(t)).cast("long"),
            word_chars=F.length(F.translate(t, BLANKS, "")).cast("long"),
            n_symbols=(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            n_dup_lines=let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            n_repeat_words=_repeat_words(words_of(t)),
        ),
        base_failed=(F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _vector() -> dict[str, Column]:
    """Transformed statistics: logarithms of sizes, square roots of shares (stabilise variance)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "log_word_len": F.log1p(F.col("word_chars") / n),
        "symbol_share": F.sqrt(F.col("n_symbols") / n),
        "dup_share": F.sqrt(F.col("n_dup_lines") / n),
        "repeat_share": F.sqrt(F.col("n_repeat_words") / n),
    }


def _groups(stats: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> group id: own group, the language's pool, or the common pool."""
    own = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < min_rows
    pools = own.filter(small).groupBy("lang").agg(F.sum("n").alias("pooled"))
    joined = own.join(pools.withColumnRenamed("lang", "pool_lang"), F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    level = F.when(~small, 0).when(F.col("pooled") >= min_rows, 1).otherwise(2)
    name = F.to_json(F.struct(level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level == 0, F.col("source")).alias("source")))
    return joined.select("lang", "source", name.alias("grp"))


def _sums() -> list[Column]:
    """Count, sums and sums of products of the dimensions: all that a mean and a covariance need."""
    sums = ["count(*) AS n"] + [f"sum({d}) AS s_{d}" for d in DIMS]
    return [F.expr(x) for x in sums + [f"sum({a} * {b}) AS s_{i}_{j}" for i, a in enumerate(DIMS) for j, b in enumerate(DIMS) if j <= i]]


def _moments(g: DataFrame, consistency: float, min_rows: int) -> DataFrame:
    """Mean (m) and inverse of the covariance's Cholesky factor (w) per group, from its sums.

    SQL text: one call of the JVM for each entry of the matrices, not one for each of its terms.
    """
    g = g.filter(F.col("n") >= min_rows // 2).selectExpr("*", *[f"s_{d} / n AS m{i}" for i, d in enumerate(DIMS)])

    def rest(i: int, j: int) -> str:
        floor = f" + {FLOORS[DIMS[i]] ** 2!r}D" if i == j else ""
        return f"(s_{i}_{j} / n - m{i} * m{j}) * {consistency!r}D{floor}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))

    for j, d in enumerate(DIMS):  # Cholesky factor, column by column
        g = g.selectExpr("*", f"sqrt(greatest({rest(j, j)}, {FLOORS[d] ** 2!r}D)) AS l{j}{j}")
        g = g.selectExpr("*", *[f"({rest(i, j)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)])
    g = g.selectExpr("*", *[f"1 / l{i}{i} AS w{i}{i}" for i in range(P)])
    for off in range(1, P):  # its inverse, diagonal by diagonal
        g = g.selectExpr("*", *[f"-({' + '.join(f'l{i}{k} * w{k}{i - off}' for k in range(i - off, i))}) * w{i}{i} AS w{i}{i - off}" for i in range(off, P)])
    return g.select("grp", *_PARAMETERS)


def _distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Add the squared Mahalanobis distance ``d2`` (null where the group has no model).

    One expression that names each part once: the planner copies it into filters, where a chain of
    forward substitution doubles with every dimension.
    """
    z = [" + ".join(f"w{i}{j} * ({DIMS[j]} - m{j})" for j in range(i + 1)) for i in range(P)]
    d2 = F.expr(" + ".join(f"power({x}, 2.0D)" for x in z))
    return rows.join(model, "grp", "left").withColumn("d2", d2).drop(*[c for c in model.columns if c != "grp"])


def _bucket(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BUCKETS_PER_OCTAVE)


def _nearest(hist: DataFrame, share: float) -> DataFrame:
    """Per group: the sums of its nearest rows, up to the first bucket at which the count reaches ``share`` of all."""
    w = Window.partitionBy("grp")
    cum = hist.withColumn("cum", F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("n").over(w))
    near = cum.filter(F.col("cum") - F.col("n") < F.col("tot") * share)
    return near.groupBy("grp").agg(*[F.sum(c).alias(c) for c in hist.columns if c not in ("grp", "b")])


def _start(rows: DataFrame) -> DataFrame:
    """Deterministic first subset: coordinate-wise medians and interquartile ranges, from histograms."""
    long = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(d) * 64) for d in DIMS])).alias("dim", "b"))
    hist = stage(long.groupBy("grp", "dim", "b").agg(F.count("*").alias("c")), "mcd-start")
    w = Window.partitionBy("grp", "dim")
    cum = hist.withColumn("cum", F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("c").over(w))
    q = cum.groupBy("grp", "dim").agg(*[F.min(F.when(F.col("cum") >= F.col("tot") * s, F.col("b"))).alias(f"q{int(s * 100)}") for s in (0.25, 0.5, 0.75)])
    cells = []
    for i, d in enumerate(DIMS):
        at = F.col("dim") == i
        cells += [F.max(F.when(at, (F.col("q50") + 0.5) / 64)).alias(f"m{i}")]
        cells += [F.max(F.when(at, 1 / F.greatest((F.col("q75") - F.col("q25")) / 64 / 1.35, F.lit(FLOORS[d])))).alias(f"w{i}{i}")]
        cells += [F.lit(0.0).alias(f"w{i}{j}") for j in range(i)]
    return q.groupBy("grp").agg(*[c for c in cells])


def _log_determinant() -> Column:
    return -sum((F.log(F.col(f"w{i}{i}")) for i in range(1, P)), F.log(F.col("w00")))


def mcd_model(stats: DataFrame, support: float = SUPPORT, min_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(groups, model) of the MCD estimates over the rows that pass the plain rule.

    Concentration steps go on while some group's determinant falls by more than ``SETTLED``; a group
    keeps the estimate of its smallest determinant.

    ``stats``: lang, source, the base counts and ``base_failed``. Both results are small written
    tables: one row per (lang, source) and one per group.
    """
    rows = stats.filter(~F.col("base_failed"))
    groups = stage(_groups(rows, min_rows), "mcd-groups")
    keyed = _with_group(rows, groups).select("grp", *[c.alias(k) for k, c in _vector().items()])
    keyed = stage(keyed, "mcd-rows")
    best, first = stage(_start(keyed), "mcd-model"), True
    while True:
        # one pass: sums per distance bucket, which the support threshold then cuts
        near = _distance(keyed, best).withColumn("b", _bucket(F.col("d2")))
        hist = stage(near.groupBy("grp", "b").agg(*_sums()), "mcd-histogram")
        new = _moments(_nearest(hist, support), CONSISTENCY, min_rows).withColumn("size", _log_determinant())
        state = new.withColumn("falls", F.lit(True)) if first else _better(new, best)
        state = stage(state, "mcd-model")
        best = state.drop("falls")
        if not first and state.filter("falls").isEmpty():
            break
        first = False
    final = _distance(keyed, best).filter(F.col("d2") <= REWEIGHT)
    return groups, stage(_moments(final.groupBy("grp").agg(*_sums()), 1.0, min_rows), "mcd-model")


def _better(new: DataFrame, best: DataFrame) -> DataFrame:
    """Per group the estimate of the smaller determinant, and whether that is the new one (``falls``)."""
    old = best.select("grp", F.struct(*best.columns).alias("old"))
    both = new.select("grp", F.struct(*new.columns).alias("new")).join(old, "grp", "full")
    falls = F.coalesce(F.col("new.size") < F.coalesce(F.col("old.size"), F.lit(float("inf"))) - SETTLED, F.lit(False))
    both = both.select(falls.alias("falls"), "old", "new")
    return both.select(F.when(F.col("falls") | F.col("old").isNull(), F.col("new")).otherwise(F.col("old")).alias("v"), "falls").select("v.*", "falls")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "grp")
    on = rows["lang"].eqNullSafe(g["g_lang"]) & rows["source"].eqNullSafe(g["g_source"])
    return rows.join(g, on, "left").drop("g_lang", "g_source")


def judge(stats: DataFrame, groups: DataFrame, model: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add ``d2`` (null without a model) and ``kept``."""
    rows = _with_group(stats, groups).withColumns(_vector())
    out = _distance(rows, model).drop("grp", *DIMS)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = 100) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 and kept of every row of documents."""
    stats = stage(text_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-stats")
    groups, model = mcd_model(stats, min_rows=min_rows)
    return judge(stats, groups, model, cutoff).select("doc_id", *COUNTS, "base_failed", "d2", "kept")


def quality_filter(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = 100) -> DataFrame:
    """The rows of documents that are kept, with their own columns."""
    row = F.struct(*[F.col(quote(c)) for c in docs.columns]).alias("row")
    annotated = stage(text_statistics(docs.select(row, "text", "lang", "source")).drop("text"), "quality-docs")
    groups, model = mcd_model(annotated.drop("row"), min_rows=min_rows)
    return judge(annotated, groups, model, cutoff).filter("kept").select("row.*")
