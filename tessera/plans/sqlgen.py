"""DuckDB text fragments for the oracle queries (the derived views, written out in SQL)."""

from __future__ import annotations

from tessera import constants as C
from tessera.plans.games import SIZE_CATEGORY, TYPE_CATEGORY, UNMAPPED_LANGUAGE, games_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def bucket_sql(col: str, bounds, open_label) -> str:
    arms = " ".join(f"WHEN {col} <= {b} THEN {q(lbl)}" for b, lbl in bounds)
    if open_label is not None:
        arms += f" WHEN {col} > {bounds[-1][0]} THEN {q(open_label)}"
    return f"(CASE {arms} ELSE {q(C.UNKNOWN_BUCKET)} END)"


def sorted_labels(bounds, open_label):
    labels = [lbl for _, lbl in bounds] + ([open_label] if open_label else [])
    return sorted(labels)


AGE_VALUES = sorted_labels(C.AGE_BUCKETS, C.AGE_OPEN_LABEL)
DURATION_VALUES = sorted_labels(C.DURATION_BUCKETS, C.DURATION_OPEN_LABEL)
DIFFICULTY_VALUES = sorted_labels(C.DIFFICULTY_BUCKETS, C.DIFFICULTY_OPEN_LABEL)
CATEGORY_VALUES = sorted({c for _, c in TYPE_CATEGORY} | {c for c in SIZE_CATEGORY if c})
LANGUAGE_VALUES = sorted(set(C.LANGUAGE_DEPENDENCY_MAPPING.values()) | {UNMAPPED_LANGUAGE})


def scalar_flags(col: str, prefix: str, values) -> list[tuple[str, str]]:
    return [(f"{prefix}_{v.lower()}", f"CAST(COALESCE({col} = {q(v)}, false) AS INTEGER)") for v in values]


def list_flags(col: str, prefix: str, values) -> list[tuple[str, str]]:
    return [(f"{prefix}_{v.lower()}", f"CAST(COALESCE(list_contains({col}, {q(v)}), false) AS INTEGER)")
            for v in values]


def category_group_flags(cat_col: str = "categories") -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(group flag columns, surviving unmapped category columns)."""
    present = {v.lower(): v for v in CATEGORY_VALUES}
    mapped = set()
    groups = []
    for g, members in C.CATEGORY_GROUPS.items():
        hits = [present[m] for m in members if m in present]
        mapped.update(m for m in members if m in present)
        if hits:
            cond = " OR ".join(f"COALESCE(list_contains({cat_col}, {q(h)}), false)" for h in hits)
            groups.append((f"{C.CATEGORY_GROUP_PREFIX}_{g}", f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER)"))
        else:
            groups.append((f"{C.CATEGORY_GROUP_PREFIX}_{g}", "CAST(0 AS INTEGER)"))
    unmapped = [v for k, v in present.items() if k not in mapped]
    return groups, list_flags(cat_col, C.CATEGORY_PREFIX, sorted(unmapped))


def language_encoded_sql(col: str = "language_dependence_description") -> str:
    arms = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in C.LANGUAGE_DEPENDENCY_MAPPING.items())
    return f"(CASE {arms} ELSE {col} END)"


def popularity_sql(src: str) -> str:
    w = C.POPULARITY_WEIGHTS
    return (
        f"COALESCE(CAST(owned_by AS DOUBLE) / NULLIF(CAST(mo AS DOUBLE), 0), 0.0) * CAST({w['owned_by']} AS DOUBLE)"
        f" + COALESCE(CAST(wished_by AS DOUBLE) / NULLIF(CAST(mw AS DOUBLE), 0), 0.0) * CAST({w['wished_by']} AS DOUBLE)"
        f" + COALESCE(CAST(num_rates AS DOUBLE) / NULLIF(CAST(mr AS DOUBLE), 0), 0.0) * CAST({w['num_rates']} AS DOUBLE)"
        f" + (avg_rating / 10.0) * CAST({w['avg_rating']} AS DOUBLE)"
    )


def feature_flag_columns() -> list[tuple[str, str]]:
    """All model feature flags of the prepared table, as (name, expression over `b`)."""
    groups, unmapped = category_group_flags()
    return (
        scalar_flags("age_group", C.AGE_PREFIX, AGE_VALUES)
        + scalar_flags("playing_time_group", C.DURATION_PREFIX, DURATION_VALUES)
        + scalar_flags("game_difficulty_group", C.DIFFICULTY_PREFIX, DIFFICULTY_VALUES)
        + unmapped
        + groups
        + scalar_flags("language_dependence_description_encoded", C.LANGUAGE_PREFIX, LANGUAGE_VALUES)
    )


def feature_names_in_order() -> list[str]:
    """Feature columns in the order :func:`feature_columns` yields them on the Spark side."""
    names = [n for n, _ in feature_flag_columns()]
    out = []
    for p in C.FEATURE_PREFIXES:
        # Spark column order: age, duration, difficulty, unmapped cats, groups, language
        out.extend(n for n in names if n.startswith(p))
    return out


def prepared_ctes() -> str:
    """CTEs ``games``, ``f1`` (quality filter), ``prepared`` (all derived columns)."""
    age = bucket_sql("suggested_play_age", C.AGE_BUCKETS, C.AGE_OPEN_LABEL)
    dur = bucket_sql("playing_time", C.DURATION_BUCKETS, C.DURATION_OPEN_LABEL)
    dif = bucket_sql("avg_weight", C.DIFFICULTY_BUCKETS, C.DIFFICULTY_OPEN_LABEL)
    flags = ",\n    ".join(f"{e} AS {ident(n)}" for n, e in feature_flag_columns())
    return f"""games AS ({games_sql()}),
f1 AS (SELECT * FROM games WHERE num_rates >= {C.MIN_NUM_RATES} AND avg_rating >= {C.MIN_AVG_RATING}),
mx AS (SELECT MAX(owned_by) AS mo, MAX(wished_by) AS mw, MAX(num_rates) AS mr FROM f1),
scored AS (SELECT f1.*, {popularity_sql('f1')} AS popularity_score FROM f1 CROSS JOIN mx),
bk AS (SELECT *, {age} AS age_group, {dur} AS playing_time_group, {dif} AS game_difficulty_group,
              {language_encoded_sql()} AS language_dependence_description_encoded FROM scored),
b AS (SELECT * FROM bk WHERE age_group <> 'Unknown' AND playing_time_group <> 'Unknown'
        AND game_difficulty_group <> 'Unknown' AND language_dependence_description IS NOT NULL),
prepared AS (SELECT *,
    CAST(min_players <= 1 AS INTEGER) AS GROUP_SIZE_solo,
    CAST(min_players <= 2 AND max_players >= 2 AS INTEGER) AS GROUP_SIZE_couple,
    CAST(min_players >= 3 AND max_players <= 5 AS INTEGER) AS GROUP_SIZE_small,
    CAST(max_players >= 6 AS INTEGER) AS GROUP_SIZE_party,
    {flags}
  FROM b)"""
