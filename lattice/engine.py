"""Sources by name, and the queries, pivots and trees over them."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lattice.errors import LimitExceeded, UnknownSource
from lattice.operators.flat import lower, predicate
from lattice.operators.pivot import PivotLimits, PivotQuery, PivotResult, run_pivot, validate_pivot
from lattice.operators.tree import Prepared, TreeResult, prepare, run_tree
from lattice.plans.query import Limits, Query, Valid, check_filter, validate
from lattice.policy import Policy
from lattice.types import Field, Schema, propose, shaped


@dataclass
class Source:
    df: DataFrame
    schema: Schema
    left_out: list[str]
    unique: tuple[str, ...] = ()
    policy: Policy = Policy()


class Result:
    """A page (df), its columns, and the number of rows before paging, which is counted when asked for."""

    def __init__(self, df: DataFrame, output: list[Field], all_rows: DataFrame, known: int | None, remember, tree: TreeResult | None = None):
        self.df, self.output, self.tree = df, output, tree
        self._rows, self._known, self._remember = all_rows, known, remember

    @property
    def total_count(self) -> int:
        if self._known is None:
            self._known = self._rows.count()
            self._remember(self._known)
        return self._known


class Engine:
    def __init__(self, spark: SparkSession, limits: Limits = Limits(), pivot_limits: PivotLimits = PivotLimits(), count_ttl: float = 5.0, max_tree_rows: int = 5_000_000):
        self.spark, self.limits, self.pivot_limits = spark, limits, pivot_limits
        self.count_ttl, self.max_tree_rows = count_ttl, max_tree_rows
        self.sources: dict[str, Source] = {}
        self._counts: dict[tuple[str, str], tuple[float, int]] = {}
        self._trees: dict[tuple[str, str], Prepared] = {}

    def register(self, name: str, df: DataFrame, schema: Schema | None = None, unique: tuple[str, ...] = (), policy: Policy = Policy()) -> Source:
        """Load or replace a source. Without a schema one is proposed; columns that have no type are named in left_out."""
        proposed, left = propose(df)
        schema = schema or proposed
        found = Source(shaped(df, schema), schema, left, unique, policy)
        self._where(found)  # a policy that can't be applied is refused here
        self.sources[name] = found
        self.notify_changed(name)
        return found

    def unload(self, name: str) -> None:
        self.sources.pop(name, None)
        self.notify_changed(name)

    def notify_changed(self, name: str) -> None:
        """The source's data has changed: remembered counts and prepared trees go."""
        self._counts = {k: v for k, v in self._counts.items() if k[0] != name}
        self._trees = {k: v for k, v in self._trees.items() if k[0] != name}

    def _source(self, name: str) -> Source:
        if name not in self.sources:
            raise UnknownSource(f"no source {name!r}")
        return self.sources[name]

    def _where(self, s: Source) -> Any:
        f = s.policy.where()
        return None if f is None else check_filter(f, s.schema, self.limits, "policy")

    def _client(self, s: Source) -> Schema:
        return s.schema if s.policy.fields is None else s.schema.narrowed(list(s.policy.fields))

    def _admit(self, j: Any) -> tuple[Source, Valid]:
        """Read and validated against what the client may see, then given the row filter (on a tree: as scope only)."""
        q = Query.from_json(j)
        s = self._source(q.source)
        q = replace(q, limit=self.limits.max_limit if q.limit is None else q.limit)
        return s, validate(q, self._client(s), self.limits)

    def execute(self, j: Any) -> Result:
        s, valid = self._admit(j)
        where, q = self._where(s), valid.query
        df = s.df if where is None else s.df.where(predicate(where))
        if q.tree:
            key = (q.source, json.dumps([q.tree.key, q.tree.parent, q.tree.scope], sort_keys=True, default=str))
            if key not in self._trees:
                self._trees[key] = prepare(df, valid, self.max_tree_rows)
            t = run_tree(df, valid, s.schema, self._trees[key])
            return Result(t.df, valid.output, t.all_rows, None, lambda n: None, t)
        out, rows = lower(df, valid, s.schema, s.unique)
        key = (q.source, json.dumps([q.filter, q.group, [vars(a) for a in q.aggregate] if q.group else []], sort_keys=True, default=str))
        known = 1 if q.aggregate and not q.group else None
        at, n = self._counts.get(key, (0.0, 0))
        if known is None and time.monotonic() - at < self.count_ttl and key in self._counts:
            known = n
        return Result(out, valid.output, rows, known, lambda n: self._counts.__setitem__(key, (time.monotonic(), n)))

    def pivot(self, j: Any) -> PivotResult:
        p = PivotQuery.from_json(j)
        s = self._source(p.source)
        filtered = validate_pivot(p, self._client(s), self.pivot_limits, self.limits)
        where = self._where(s)
        df = s.df if where is None else s.df.where(predicate(where))
        return run_pivot(df, p, s.schema, filtered, self.pivot_limits)
