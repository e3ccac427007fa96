"""Feature preparation operators: DataFrame -> DataFrame, parameters default to the fixed
values in :mod:`tessera.constants`.

All of them are narrow (no shuffle) except the two that need a global fact:
* :func:`add_popularity_score` needs three column maxima -> one partial/final aggregate,
  joined back as a broadcast 1-row relation (bounded: exactly one row);
* :func:`one_hot_encode` needs the vocabulary -> one distinct aggregate whose result is
  size-checked before it reaches the driver; the flags are then one wide ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as C
from tessera.functions.text import clean_text

MAX_VOCABULARY = 4096


# ---------------------------------------------------------------- filters
def quality_filter(df: DataFrame, min_num_rates: int = C.MIN_NUM_RATES,
                   min_avg_rating: float = C.MIN_AVG_RATING) -> DataFrame:
    """Pushed into the parquet scan when ``df`` is a scan (see ``explain``)."""
    return df.filter((F.col("num_rates") >= min_num_rates) & (F.col("avg_rating") >= min_avg_rating))


def clean_text_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, clean_text(column))


# ---------------------------------------------------------------- popularity
def add_popularity_score(df: DataFrame, weights: dict | None = None,
                         out: str = "popularity_score") -> DataFrame:
    """w_o*owned/max(owned) + w_w*wished/max(wished) + w_n*rates/max(rates) + w_r*avg/10.

    Maxima are over ``df`` as given (after the quality filter, before bucket drops). A zero
    or missing maximum contributes 0 instead of raising (ANSI) or producing NaN.
    """
    w = weights or C.POPULARITY_WEIGHTS
    maxima = df.agg(
        F.max("owned_by").alias("__max_owned"),
        F.max("wished_by").alias("__max_wished"),
        F.max("num_rates").alias("__max_rates"),
    )
    joined = df.crossJoin(F.broadcast(maxima))  # exactly one row: bounded broadcast

    def part(c: str, m: str, weight: float) -> Column:
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(m).cast("double")), F.lit(0.0)) * F.lit(weight)

    score = (
        part("owned_by", "__max_owned", w["owned_by"])
        + part("wished_by", "__max_wished", w["wished_by"])
        + part("num_rates", "__max_rates", w["num_rates"])
        + (F.col("avg_rating") / F.lit(10.0)) * F.lit(w["avg_rating"])
    )
    return joined.withColumn(out, score).drop("__max_owned", "__max_wished", "__max_rates")


# ---------------------------------------------------------------- buckets
def bucket_column(col: Column, bounds: Sequence[tuple[float, str]], open_label: str | None,
                  unknown: str = C.UNKNOWN_BUCKET) -> Column:
    """Right-closed bins ``(-inf, b1], (b1, b2], ...``; above the last bound -> ``open_label``
    (or unknown). Null and NaN beyond a closed last bound are unknown. ``Bucketizer`` is
    left-closed, so it cannot express these bins."""
    expr = None
    for bound, label in bounds:
        cond = col <= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if open_label is not None:
        expr = expr.when(col > F.lit(bounds[-1][0]), F.lit(open_label))
    return expr.otherwise(F.lit(unknown))


def bucketize(df: DataFrame, column: str, out: str, bounds, open_label, drop_unknown: bool = True,
              unknown: str = C.UNKNOWN_BUCKET) -> DataFrame:
    res = df.withColumn(out, bucket_column(F.col(column), bounds, open_label, unknown))
    return res.filter(F.col(out) != F.lit(unknown)) if drop_unknown else res


def bucket_age(df: DataFrame) -> DataFrame:
    return bucketize(df, "suggested_play_age", "age_group", C.AGE_BUCKETS, C.AGE_OPEN_LABEL)


def bucket_duration(df: DataFrame) -> DataFrame:
    return bucketize(df, "playing_time", "playing_time_group", C.DURATION_BUCKETS, C.DURATION_OPEN_LABEL)


def bucket_difficulty(df: DataFrame) -> DataFrame:
    return bucketize(df, "avg_weight", "game_difficulty_group", C.DIFFICULTY_BUCKETS, C.DIFFICULTY_OPEN_LABEL)


# ---------------------------------------------------------------- range flags
def range_flags(df: DataFrame, lo: str = "min_players", hi: str = "max_players",
                prefix: str = C.GROUP_SIZE_PREFIX) -> DataFrame:
    """Overlapping player-count flags; null inputs give null flags."""
    mn, mx = F.col(lo), F.col(hi)
    return df.select(
        "*",
        (mn <= 1).cast("int").alias(f"{prefix}_solo"),
        ((mn <= 2) & (mx >= 2)).cast("int").alias(f"{prefix}_couple"),
        ((mn >= 3) & (mx <= 5)).cast("int").alias(f"{prefix}_small"),
        (mx >= 6).cast("int").alias(f"{prefix}_party"),
    )


# ---------------------------------------------------------------- one-hot
def _is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Union of the distinct non-null values of scalar and list columns (one column ``value``)."""
    parts = []
    for c in columns:
        if _is_array(df, c):
            parts.append(df.select(F.explode(F.col(c)).alias("value")).select(F.col("value").cast("string")))
        else:
            parts.append(df.select(F.col(c).cast("string").alias("value")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.filter(F.col("value").isNotNull()).distinct()


def vocabulary(df: DataFrame, columns: Sequence[str], max_values: int = MAX_VOCABULARY) -> list[str]:
    """Sorted vocabulary; only the (size-checked) distinct values reach the driver."""
    rows = distinct_values(df, columns).limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"one-hot vocabulary of {columns} exceeds {max_values} values")
    return sorted(r["value"] for r in rows)


def one_hot_columns(df: DataFrame, columns: Sequence[str], values: Sequence[str],
                    prefix: str | None) -> list[tuple[str, Column]]:
    """One 0/1 column per value: max over the columns of (equal | contained).

    Values that collide after lower-casing share one column (flags OR-ed)."""
    by_name: dict[str, list[str]] = {}
    for v in values:
        name = f"{prefix}_{v.lower()}" if prefix else v.lower()
        by_name.setdefault(name, []).append(v)
    is_array = {c: _is_array(df, c) for c in columns}  # one schema lookup per column
    out = []
    for name, vs in by_name.items():
        hits = []
        for c in columns:
            for v in vs:
                if is_array[c]:
                    hits.append(F.coalesce(F.array_contains(F.col(c), F.lit(v)), F.lit(False)))
                else:
                    hits.append(F.coalesce(F.col(c) == F.lit(v), F.lit(False)))
        flag = hits[0]
        for h in hits[1:]:
            flag = flag | h
        out.append((name, flag.cast("int")))
    return out


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str] | str, prefix: str | None = None) -> DataFrame:
    """The one-hot encoding in long form: (key, feature) for every flag that is 1. It needs no
    vocabulary, so designers, publishers and other free lists of any size can be encoded."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    lists = [F.col(c) if _is_array(df, c) else F.array(F.col(c).cast("string")) for c in cols]
    values = F.flatten(F.array(*[F.coalesce(v.cast("array<string>"), F.array().cast("array<string>")) for v in lists]))
    names = F.array_distinct(F.transform(F.array_compact(values), lambda v: F.concat(F.lit(f"{prefix}_" if prefix else ""), F.lower(v))))
    return df.select(key, F.explode(names).alias("feature"))


def one_hot_encode(df: DataFrame, columns: Sequence[str] | str, prefix: str | None = None,
                   values: Sequence[str] | None = None) -> DataFrame:
    """Adds (or replaces) one flag column per vocabulary value in a single ``select``."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    vocab = list(values) if values is not None else vocabulary(df, cols)
    new = one_hot_columns(df, cols, vocab, prefix)
    names = {n for n, _ in new}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*keep, *[c.alias(n) for n, c in new])


# ---------------------------------------------------------------- grouping / encoding
def group_indicators(df: DataFrame, groups: dict[str, list[str]] | None = None,
                     member_prefix: str = C.CATEGORY_PREFIX,
                     group_prefix: str = C.CATEGORY_GROUP_PREFIX) -> DataFrame:
    """Per group: 1 if any present member indicator equals 1, else 0; then drop the mapped
    member indicators. Unmapped indicators survive."""
    groups = groups or C.CATEGORY_GROUPS
    named = {g: {f"{member_prefix}_{m}" for m in members} for g, members in groups.items()}
    mapped = set().union(*named.values())
    keep = [F.col(f"`{c}`") for c in df.columns if c not in mapped]
    flags = [_any_set([F.col(f"`{c}`") for c in df.columns if c in names]).alias(f"{group_prefix}_{g}")
             for g, names in named.items()]
    return df.select(*keep, *flags)


def _any_set(flags: list[Column]) -> Column:
    """1 if the flags hold a 1 (nulls do not count), else 0."""
    return F.array_max(F.array(F.lit(0), *[F.when(f == 1, 1) for f in flags]))


def encode_mapping(df: DataFrame, column: str, mapping: dict | None = None,
                   out: str | None = None) -> DataFrame:
    """Drop null rows, map values through ``mapping`` (unmapped pass through) into
    ``<column>_encoded``; cast to int only when every mapped value is an int."""
    mapping = {k: v for k, v in (mapping or C.LANGUAGE_DEPENDENCY_MAPPING).items() if k is not None}
    out = out or f"{column}_encoded"
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    encoded = F.coalesce(F.try_element_at(m, F.col(column)), F.col(column))
    if mapping and all(isinstance(v, int) for v in mapping.values()):
        encoded = encoded.cast("int")
    return df.filter(F.col(column).isNotNull()).withColumn(out, encoded)


def feature_columns(df: DataFrame | Sequence[str], prefixes: Sequence[str] = C.FEATURE_PREFIXES) -> list[str]:
    """Columns starting with each prefix, in prefix order then column order (no de-dup)."""
    cols = df.columns if isinstance(df, DataFrame) else list(df)
    out = []
    for p in prefixes:
        out.extend(c for c in cols if c.startswith(p))
    return out


# ---------------------------------------------------------------- whole pipeline
LANGUAGE_COLUMN = "language_dependence_description"


def _bucket_exprs():
    return (bucket_column(F.col("suggested_play_age"), C.AGE_BUCKETS, C.AGE_OPEN_LABEL),
            bucket_column(F.col("playing_time"), C.DURATION_BUCKETS, C.DURATION_OPEN_LABEL),
            bucket_column(F.col("avg_weight"), C.DIFFICULTY_BUCKETS, C.DIFFICULTY_OPEN_LABEL))


def _encoded_language(mapping: dict | None = None) -> Column:
    mapping = {k: v for k, v in (mapping or C.LANGUAGE_DEPENDENCY_MAPPING).items() if k is not None}
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(LANGUAGE_COLUMN)), F.col(LANGUAGE_COLUMN))


def pipeline_vocabularies(df: DataFrame, max_values: int = MAX_VOCABULARY) -> dict[str, list[str]]:
    """Every one-hot vocabulary of :func:`prepare_features`, each over exactly the rows that
    reach its step, in ONE distributed job: (vocabulary, value) pairs are de-duplicated by a
    shuffle on the pair, and at most ``5 * max_values + 1`` of them are fetched — so neither
    one task nor the driver ever holds an unbounded vocabulary; an oversized one raises."""
    age, dur, dif = _bucket_exprs()
    unk = F.lit(C.UNKNOWN_BUCKET)
    staged = quality_filter(df).select(age.alias("a"), dur.alias("d"), dif.alias("f"),
                                       F.explode_outer("categories").alias("cat"),
                                       _encoded_language().alias("lang"))
    ok_a = F.col("a") != unk
    ok_d = ok_a & (F.col("d") != unk)
    ok_f = ok_d & (F.col("f") != unk)
    kinds = [(C.AGE_PREFIX, ok_a, "a"), (C.DURATION_PREFIX, ok_d, "d"), (C.DIFFICULTY_PREFIX, ok_f, "f"),
             (C.CATEGORY_PREFIX, ok_f, "cat"), (C.LANGUAGE_PREFIX, ok_f, "lang")]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(ok, F.col(c)).alias("value")) for k, ok, c in kinds])
    vocab = (staged.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
             .distinct().limit(len(kinds) * max_values + 1).collect())
    out: dict[str, list[str]] = {k: [] for k, _, _ in kinds}
    for r in vocab:
        out[r["kind"]].append(r["value"])
    for k, v in out.items():
        if len(v) > max_values:
            raise ValueError(f"one-hot vocabulary {k} exceeds {max_values} values")
    return {k: sorted(v) for k, v in out.items()}


def prepare_features(df: DataFrame, text_column: str | None = "description",
                     vocabularies: dict[str, Sequence[str]] | None = None,
                     groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Quality filter -> text clean -> popularity -> age/duration/difficulty buckets with
    one-hots -> player-count flags -> category one-hot + grouping -> language encode +
    one-hot; the same result as chaining the step operators, expressed as ONE projection
    and ONE filter over the scan (plus the 1-row maxima aggregate) so Catalyst analyses a
    single wide select. ``vocabularies`` (prefix -> values) skips the vocabulary pass."""
    voc = vocabularies if vocabularies is not None else pipeline_vocabularies(df)
    groups = groups or C.CATEGORY_GROUPS
    base = quality_filter(df)
    if text_column and text_column in base.columns:
        base = clean_text_column(base, text_column)
    base = add_popularity_score(base)
    age, dur, dif = _bucket_exprs()
    staged = base.select("*", age.alias("age_group"), dur.alias("playing_time_group"),
                         dif.alias("game_difficulty_group"),
                         _encoded_language().alias(f"{LANGUAGE_COLUMN}_encoded"))
    flags: list[tuple[str, Column]] = []
    flags += one_hot_columns(staged, ["age_group"], voc[C.AGE_PREFIX], C.AGE_PREFIX)
    flags += one_hot_columns(staged, ["playing_time_group"], voc[C.DURATION_PREFIX], C.DURATION_PREFIX)
    flags += one_hot_columns(staged, ["game_difficulty_group"], voc[C.DIFFICULTY_PREFIX], C.DIFFICULTY_PREFIX)
    mn, mx = F.col("min_players"), F.col("max_players")
    flags += [(f"{C.GROUP_SIZE_PREFIX}_solo", (mn <= 1).cast("int")),
              (f"{C.GROUP_SIZE_PREFIX}_couple", ((mn <= 2) & (mx >= 2)).cast("int")),
              (f"{C.GROUP_SIZE_PREFIX}_small", ((mn >= 3) & (mx <= 5)).cast("int")),
              (f"{C.GROUP_SIZE_PREFIX}_party", (mx >= 6).cast("int"))]
    cats = one_hot_columns(staged, ["categories"], voc[C.CATEGORY_PREFIX], C.CATEGORY_PREFIX)
    member_of = {f"{C.CATEGORY_PREFIX}_{m}": g for g, ms in groups.items() for m in ms}
    flags += [(n, c) for n, c in cats if n not in member_of]          # unmapped indicators survive
    for g, ms in groups.items():  # one overlap of the row's list with the group's members
        named = {f"{C.CATEGORY_PREFIX}_{m}" for m in ms}
        members = [v for v in voc[C.CATEGORY_PREFIX] if f"{C.CATEGORY_PREFIX}_{v.lower()}" in named]
        overlap = F.arrays_overlap("categories", F.array(*map(F.lit, members))) if members else F.lit(False)
        flags.append((f"{C.CATEGORY_GROUP_PREFIX}_{g}", F.coalesce(overlap, F.lit(False)).cast("int")))
    flags += one_hot_columns(staged, [f"{LANGUAGE_COLUMN}_encoded"], voc[C.LANGUAGE_PREFIX], C.LANGUAGE_PREFIX)
    unk = F.lit(C.UNKNOWN_BUCKET)
    keep = ((F.col("age_group") != unk) & (F.col("playing_time_group") != unk)
            & (F.col("game_difficulty_group") != unk) & F.col(LANGUAGE_COLUMN).isNotNull())
    return staged.filter(keep).select("*", *[c.alias(n) for n, c in flags])
