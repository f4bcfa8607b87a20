"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scalar import origin_tier

# Type vocabularies.
INTERNAL = ("Version", "entity", "relation", "pattern")
USER_TYPES = ("pending", "semantic", "episodic", "procedural", "zettel", "reasoning", "opinion", "observation", "decision")
EXPERTISE = ("decision", "constraint", "learned", "opinion", "observation")


# Folders that code indexing leaves out.
NO_CODE = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "tmp")


def not_internal() -> Column:
    return ~F.coalesce(F.col("memory_type"), F.lit("")).isin(*INTERNAL) & ~F.coalesce(F.col("node_category"), F.lit("")).isin("entity", "relation")


def not_version() -> Column:
    return ~F.col("memory_type").eqNullSafe("Version")


def not_reference() -> Column:
    return ~F.coalesce(F.col("reference"), F.lit(False))


def in_tiers(tiers: tuple[int, ...] = (1, 2)) -> Column:
    return origin_tier(F.col("origin")).isin(*tiers)


def in_workspace(workspace: str | None, strict: bool = False) -> Column:
    if not workspace:
        return F.lit(True)
    own = F.col("workspace_id") == workspace
    return F.coalesce(own, F.lit(False)) if strict else F.coalesce(own, F.lit(True))


def confident(floor: float = 0.3) -> Column:
    return F.coalesce(F.col("confidence"), F.lit(1.0)) >= floor


def has_properties(df: DataFrame, wanted: dict[str, str], map_col: str = "props") -> Column:
    """Every pair is met by a column of that name or by the property map."""
    tests = []
    for k, v in wanted.items():
        sides = ([F.col(k).cast("string") == v] if k in df.columns else []) + ([F.try_element_at(map_col, F.lit(k)) == v] if map_col in df.columns else [])
        tests.append(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), sides, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def mentions(needle: str, col: str = "content") -> Column:
    return F.coalesce(F.contains(F.lower(F.col(col)), F.lit(needle.lower())), F.lit(False))


def code_path(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """No folder on the path is left out; the defaults and the caller's own together."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(f) for f in sorted({*NO_CODE, *extra}))))


def snapshot_matches(workspace: str | None, own: Column) -> Column:
    """An unknown workspace on either side matches."""
    return F.lit(True) if workspace is None else own.isNull() | (own == workspace)


def in_domain(domain: str | None, col: Column) -> Column:
    return F.lit(True) if domain is None else F.coalesce(col == domain, F.lit(False))
