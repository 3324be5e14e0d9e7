"""Trees over a parent field: one level with its context and subtree aggregates, or the whole tree depth-first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.errors import DataError, LimitExceeded
from lattice.operators.flat import aggregate, page, predicate, sort_keys
from lattice.plans.query import Valid
from lattice.runtime import staged, with_rank
from lattice.types import Schema, column_of

_K, _P, _M = "__key", "__parent", "__match"


@dataclass
class TreeResult:
    """df: the page; a level's rows have __children and __matched, a flat tree's level, path and (with a filter) match."""

    df: DataFrame
    all_rows: DataFrame
    count: Callable[[], int]
    orphans: int
    aggregates: DataFrame | None = None

    @cached_property
    def matches(self) -> int:
        """How many rows in scope match, counted when asked for."""
        return self.count()


@dataclass
class Prepared:
    """What a tree's queries share: rows in scope with key, resolved parent (null for roots and orphans) and number of children."""

    rows: DataFrame
    n: int
    orphans: int


def prepare(df: DataFrame, valid: Valid, at_most: int | None = None) -> Prepared:
    """Checks keys and cycles, resolves parents and counts children; it depends on the source, the scope and the two fields only."""
    t = valid.query.tree
    rows = df if valid.scope is None else df.where(predicate(valid.scope))
    if at_most is not None and (n := df.count()) > at_most:
        raise LimitExceeded(f"{n} rows; a tree has {at_most} at most")
    rows = rows.withColumns({_K: F.col(t.key), "__named": F.col(t.parent)})
    twice = rows.where(F.col(_K).isNotNull()).groupBy(_K).count().where("count > 1").orderBy(_K).first()
    if twice:
        raise DataError(f"the key {twice[0]!r} is not unique")
    keys = rows.where(F.col(_K).isNotNull()).select(F.col(_K).alias(_P))
    rows = rows.join(keys, F.col("__named") == F.col(_P), "left")
    counts = rows.where(F.col(_P).isNotNull()).groupBy(F.col(_P).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.join(counts, F.col(_K) == F.col("__of"), "left").withColumn("__children", F.coalesce("__n", F.lit(0).cast("bigint")))
    rows = staged(rows.drop("__of", "__n"), "tree-nodes")
    n, orphans = rows.agg(F.count(F.lit(1)), F.count_if(F.col("__named").isNotNull() & F.col(_P).isNull())).first()
    _check_cycles(rows)
    return Prepared(rows, n, orphans)


def _check_cycles(rows: DataFrame) -> None:
    """By pointer doubling: a node that still has an ancestor after as many doublings as nodes allow is on a cycle or below one."""
    jumps = rows.where(F.col(_K).isNotNull() & F.col(_P).isNotNull()).select(F.col(_K).alias("k"), F.col(_P).alias("j"))
    jumps = staged(jumps, "tree-jumps")
    n = jumps.count()
    for _ in range(max(1, n).bit_length() + 1):
        if jumps.isEmpty():
            return
        nxt = jumps.select(F.col("k").alias("j"), F.col("j").alias("jj"))
        jumps = staged(jumps.join(nxt, "j").select("k", F.col("jj").alias("j")), "tree-jumps")
    # every node that is left leads into a cycle; those led to are on one
    if not jumps.isEmpty():
        raise DataError(f"the tree has a cycle through {jumps.agg(F.min('j')).first()[0]!r}")


def _visible(rows: DataFrame, filtered: bool) -> DataFrame:
    """Matching rows and all their ancestors."""
    if not filtered:
        return rows
    parents = rows.where(F.col(_K).isNotNull()).select(_K, _P)
    seen = staged(rows.where(_M).select(F.col(_P).alias("a")).where("a is not null").distinct(), "tree-seen")
    frontier = seen
    while not frontier.isEmpty():
        up = frontier.join(parents, F.col("a") == F.col(_K)).select(F.col(_P).alias("a")).where("a is not null").distinct()
        frontier = staged(up.join(seen, "a", "left_anti"), "tree-frontier")
        seen = staged(seen.unionByName(frontier), "tree-seen")
    context = seen.select(F.col("a").alias("__a"))
    marked = rows.join(context, F.col(_K) == F.col("__a"), "left")
    return staged(marked.where(F.col(_M) | F.col("__a").isNotNull()).drop("__a"), "tree-visible")


def run_tree(df: DataFrame, valid: Valid, schema: Schema, prepared: Prepared | None = None) -> TreeResult:
    q, spark = valid.query, df.sparkSession
    t, filtered = q.tree, valid.filter is not None
    prepared = prepared or prepare(df, valid)
    rows = prepared.rows.withColumn(_M, F.coalesce(predicate(valid.filter), F.lit(False)) if filtered else F.lit(True))
    count = (lambda: rows.where(_M).count()) if filtered else (lambda: prepared.n)
    shown = _visible(rows, filtered)
    keys = [*sort_keys(spark, q.sort), F.col(_K).asc_nulls_last()]
    names = [f.name for f in valid.output]
    if t.flat:
        return _flat(shown, valid, keys, names, count, prepared.orphans)
    level = shown.where(F.col(_P).isNull() if valid.under is None else F.col(_P) == column_of(valid.under, schema.field(t.key).type))
    if filtered:
        children = shown.where(F.col(_P).isNotNull()).groupBy(F.col(_P).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
        level = level.join(children, F.col(_K) == F.col("__of"), "left").withColumn("__children", F.coalesce("__n", F.lit(0).cast("bigint")))
    level = level.withColumn("__matched", F.col(_M))
    if filtered or t.aggregate:
        level = staged(level.drop("__of", "__n"), "tree-level")
    out = page(level, q, keys).select(*names, "__children", "__matched")
    sums = _subtrees(rows, level, valid, schema) if t.aggregate else None
    return TreeResult(out, level, count, prepared.orphans, sums)


def _subtrees(rows: DataFrame, level: DataFrame, valid: Valid, schema: Schema) -> DataFrame:
    """For each node of the level: aggregates of it and all below, over matching rows."""
    t = valid.query.tree
    edges = rows.where(F.col(_P).isNotNull() & F.col(_K).isNotNull()).select(_K, _P)
    tops = staged(level.where(F.col(_K).isNotNull()).select(F.col(_K).alias("top"), F.col(_K).alias("node")), "tree-tops")
    parts, frontier = [tops], tops
    while True:
        frontier = staged(frontier.join(edges, F.col("node") == F.col(_P)).select("top", F.col(_K).alias("node")), "tree-below")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    below = parts[0]
    for p in parts[1:]:
        below = below.unionByName(p)
    # rows without a key have no children, but belong to their parent's subtree
    place = F.coalesce(F.col(_K), F.col(_P))
    members = below.join(rows.where(_M).withColumn("__place", place), F.col("node") == F.col("__place"))
    sums = members.groupBy("top").agg(*[aggregate(a, schema) for a in t.aggregate])
    empty = tops.select("top").join(sums.select("top"), "top", "left_anti")
    none = empty.select("top", *[(F.lit(0) if a.fn == "count" else F.lit(None)).cast(f.type.sql).alias(a.alias) for a, f in zip(t.aggregate, valid.tree_output, strict=True)])
    return sums.unionByName(none).withColumnRenamed("top", t.key)


def _flat(shown: DataFrame, valid: Valid, keys: list, names: list[str], count: Callable[[], int], orphans: int) -> TreeResult:
    """Depth-first: a node's place is the list of ranks from its root down, and lists order as the tree is read."""
    q = valid.query
    ranked = staged(with_rank(shown, *keys, name="__rank"), "tree-ranked")
    me, key = F.array("__rank"), F.array(F.col(_K).cast("string"))
    frontier = staged(ranked.where(F.col(_P).isNull()).withColumns({"__place": me, "path": key}), "tree-flat")
    parts = [frontier]
    while True:
        up = frontier.where(F.col(_K).isNotNull()).select(F.col(_K).alias("__up"), F.col("__place").alias("__up_place"), F.col("path").alias("__up_path"))
        below = ranked.join(up, F.col(_P) == F.col("__up"))
        frontier = staged(below.withColumns({"__place": F.concat("__up_place", me), "path": F.concat("__up_path", key)}).drop("__up", "__up_place", "__up_path"), "tree-flat")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    all_rows = all_rows.withColumn("level", (F.size("__place") - 1).cast("bigint"))
    extra = ["level", "path"]
    if valid.filter is not None:
        all_rows = all_rows.withColumn("match", F.col(_M))
        extra.append("match")
    return TreeResult(page(all_rows, q, [F.col("__place").asc()]).select(*names, *extra), all_rows, count, orphans)
