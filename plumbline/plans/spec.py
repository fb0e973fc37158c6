"""Models as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SharedDim:
    """A conformed dimension: a table, its key, and its attributes' columns by name."""

    name: str
    table: str
    key: str
    attributes: dict[str, str]
    hierarchy: tuple[str, ...] = ()


@dataclass(frozen=True)
class DimUse:
    """A model's dimension: a fact column, and for a shared one the dimension that it keys."""

    name: str
    column: str
    shared: SharedDim | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    description: str
    expr: str | None = None
    where: str | None = None
    num: str | None = None
    den: str | None = None
    time_agg: str = "sum"
    additive: bool = True

    @property
    def is_ratio(self) -> bool:
        return self.num is not None

    @property
    def text(self) -> str:
        """The aggregate as SQL, its own predicate included."""
        return f"{self.expr} FILTER (WHERE {self.where})" if self.where else str(self.expr)


@dataclass(frozen=True)
class Model:
    name: str
    fact: str
    time_column: str
    measures: dict[str, Measure]
    dims: dict[str, DimUse] = field(default_factory=dict)
    description: str = ""
    cadence: str | None = None
    snapshot: bool = False
    strict: bool = False
    fiscal_start: int = 1
