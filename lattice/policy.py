"""Who may see what: allowed fields, and a row filter that is and-ed to every query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from lattice.errors import LatticeError
from lattice.plans.query import check_shape


@dataclass(frozen=True)
class Policy:
    fields: tuple[str, ...] | None = None  # all, if None
    row_filter: Any = None  # a filter whose values may be {"context": key}
    context: dict[str, Any] = field(default_factory=dict)

    def where(self) -> Any:
        """The row filter with the context's values; a missing key is an error, never no filter."""

        def fill(f: Any) -> Any:
            if isinstance(f, dict):
                if set(f) == {"context"}:
                    if f["context"] not in self.context:
                        raise LatticeError(f"the context has no {f['context']!r}", "unauthorized")
                    return self.context[f["context"]]
                return {k: fill(v) for k, v in f.items()}
            return [fill(x) for x in f] if isinstance(f, list) else f

        if self.row_filter is None:
            return None
        out = fill(self.row_filter)
        check_shape(out)
        return out
