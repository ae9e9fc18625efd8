"""Declared source schemas of an event-stream dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KIND_TYPES = {"categorical": T.StringType(), "float": T.FloatType(), "integer": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _columns(given: Mapping[str, Any] | None) -> dict[str, tuple[str, Any]]:
    """name -> kind or (output name, kind), as name -> (output name, kind)."""
    out = {}
    for name, value in (given or {}).items():
        out[name] = tuple(value) if isinstance(value, (tuple, list)) and len(value) == 2 and value[0] not in KIND_TYPES else (name, value)
    return out


@dataclass(frozen=True)
class InputSchema:
    """One source. ``kind`` is static (a row for each subject), event (a time column) or range (start and end).

    ``columns``: source column -> kind, or (output name, kind); ``start_columns``/``end_columns`` add columns to
    only one end of a range. ``must_have`` filters rows (column -> True or list of values). ``event_type``
    is a name, for ranges one or three (at equal times, start, end), or ``COL:name`` for a column that holds it.
    """

    source: DataFrame | Any
    kind: str
    subject_id_col: str
    columns: Mapping[str, Any] = field(default_factory=dict)
    ts_col: str | Sequence[str] | None = None
    ts_format: str | None = None
    start_col: str | None = None
    end_col: str | None = None
    start_columns: Mapping[str, Any] = field(default_factory=dict)
    end_columns: Mapping[str, Any] = field(default_factory=dict)
    event_type: str | Sequence[str] | None = None
    must_have: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("static", "event", "range"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "static" and (self.ts_col or self.start_col or self.end_col or self.event_type):
            raise ValueError("a static source has no times and no event type")
        if self.kind == "event" and (not self.ts_col or self.start_col or self.end_col or not isinstance(self.event_type, str)):
            raise ValueError("an event source needs ts_col and one event_type, and no start or end")
        if self.kind == "range":
            if not (self.start_col and self.end_col) or self.ts_col:
                raise ValueError("a range source needs start_col and end_col, and no ts_col")
            if not isinstance(self.event_type, str) and len(self.event_type or ()) != 3:
                raise ValueError("a range has one event type or three")
        if self.kind != "range" and (self.start_columns or self.end_columns):
            raise ValueError("only ranges have columns of one end")

    def names(self, which: str = "columns") -> dict[str, tuple[str, Any]]:
        return _columns(getattr(self, which))

    def range_types(self) -> tuple[str, str, str]:
        if isinstance(self.event_type, str):
            return self.event_type, f"{self.event_type}_START", f"{self.event_type}_END"
        return tuple(self.event_type)


@dataclass(frozen=True)
class DatasetSchema:
    """One static source and any number of dynamic ones."""

    static: InputSchema
    dynamic: Sequence[InputSchema]

    def __post_init__(self):
        if self.static.kind != "static":
            raise ValueError("the first source is static")
        if any(d.kind == "static" for d in self.dynamic):
            raise ValueError("dynamic sources are events or ranges")
        self.unified()

    def unified(self) -> dict[str, str]:
        """Kinds of all dynamic output columns; raises if two sources disagree."""
        out: dict[str, str] = {}
        for s in self.dynamic:
            for which in ("columns", "start_columns", "end_columns"):
                for name, kind in s.names(which).values():
                    base = kind[0] if isinstance(kind, (tuple, list)) else kind
                    if out.setdefault(name, base) != base:
                        raise ValueError(f"{name} is {out[name]} in one source and {base} in another")
        return out

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, KIND_TYPES[k]) for n, k in self.unified().items()])
