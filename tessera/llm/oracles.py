"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from tessera.llm.common import UPPER
from tessera.llm.merkle import ARITY, LEAF_FIELDS

#: Levels that the unrolled trees have at most: 16^6 leaves a source.
LEVELS = 6
#: FIXED VALUE: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = 0xFFFFFFFF


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = f"lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}::BIGINT) ELSE a >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {bit})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend({ONES}::BIGINT, {codes}), {byte}), {ONES}::BIGINT)"


def _tree(name: str, base: str) -> tuple[list[str], str]:
    """(CTEs of the trees over ``base`` (src, pos, d), name of the table of roots). Level l of them has the
    nodes ``{name}l`` (src, pos, d, n) and their siblings in ``{name}sl`` (src, pos, lft, rgt)."""
    ctes = [f"{name}0 AS (SELECT src, pos, d, COUNT(*) OVER (PARTITION BY src) AS n FROM {base})"]
    for k in range(LEVELS):
        run = f"SELECT src, pos // {ARITY} AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {name}{k} GROUP BY src, pos // {ARITY}"
        ctes += [
            f"{name}r{k} AS ({run})",
            f"{name}s{k} AS (SELECT a.src, a.pos, a.n, array_to_string(r.ds[1:a.pos % {ARITY}], '') AS lft, "
            f"array_to_string(r.ds[a.pos % {ARITY} + 2:], '') AS rgt FROM {name}{k} a JOIN {name}r{k} r ON r.src = a.src AND r.run = a.pos // {ARITY})",
            f"{name}{k + 1} AS (SELECT src, run AS pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, "
            f"(n + {ARITY - 1}) // {ARITY} AS n FROM {name}r{k})"]
    return ctes, f"{name}{LEVELS}"


def merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in LEAF_FIELDS]
        return "sha256(" + " || ".join(f"COALESCE(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def folded(name: str, k: int) -> str:
        s = f"{name}s{k}"
        return f"CASE WHEN {s}.n = 1 THEN node ELSE sha256({s}.lft || node || {s}.rgt) END AS node"

    key = "COALESCE(CAST(doc_id AS VARCHAR), '')"
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    bad = f"{crc32_sql('key')} % 5 = 0"
    ctes = [
        f"d AS (SELECT *, {key} AS key, COALESCE('=' || source, '') AS src FROM documents)",
        f"lf AS (SELECT doc_id, src, {leaf('text')} AS leaf, CASE WHEN {bad} THEN {leaf(low)} ELSE {leaf('text')} END AS found FROM d)",
        "pl AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM lf)",
        "b AS (SELECT src, pos, leaf AS d FROM pl)"]
    own, roots = _tree("a", "b")
    ctes += [*own, f"q AS (SELECT '' AS src, row_number() OVER (ORDER BY src) - 1 AS pos, d, src AS of FROM {roots})"]
    top, root = _tree("t", "(SELECT src, pos, d FROM q)")
    ctes += top
    ctes += ["n0 AS (SELECT pl.doc_id, pl.leaf, pl.src, pl.pos, pl.found AS node, '' AS proof, q.d AS subroot, q.pos AS tpos FROM pl JOIN q ON q.of = pl.src)"]
    step = 0
    for name, src, pos in (("a", "src", "pos"), ("t", "''", "tpos")):
        for k in range(LEVELS):
            s = f"{name}s{k}"
            at = "n.src" if src == "src" else src
            ctes.append(f"n{step + 1} AS (SELECT n.doc_id, n.leaf, n.src, n.pos, {folded(name, k)}, CASE WHEN {s}.n = 1 THEN proof ELSE proof || {s}.lft || {s}.rgt END AS proof, "
                        f"n.subroot, n.tpos FROM n{step} n JOIN {s} ON {s}.src = {at} AND {s}.pos = n.{pos} // {ARITY ** k})")
            step += 1
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.d AS verified "
            f"FROM n{step} CROSS JOIN {root} r")


ORACLES = {"op11_merkle_manifest": merkle_sql()}
