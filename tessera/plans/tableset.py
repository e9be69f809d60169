"""Names of a tableset's tables, and the sets that a list of tables holds."""

from __future__ import annotations

import dataclasses
import re
from collections import Counter

from tessera.errors import UnsupportedResolution
from tessera.functions.cells import CELL_COLUMN
from tessera.plans.schema import CompressionMethod  # noqa: F401  re-exported for callers

_NAME = re.compile(r"([a-zA-Z].[a-zA-Z_0-9]+)_([0-9]{2})(_(base|compacted))?(_tmp([a-zA-Z0-9_]+))?")


@dataclasses.dataclass(frozen=True)
class Table:
    basename: str
    resolution: int
    is_compacted: bool = False
    temporary_key: str | None = None
    has_base_suffix: bool = True

    @property
    def name(self) -> str:
        return table_name(self.basename, self.resolution, self.is_compacted, self.temporary_key, self.has_base_suffix)


def table_name(basename: str, resolution: int, is_compacted: bool, temporary: str | None = None, has_base_suffix: bool = True) -> str:
    kind = "_compacted" if is_compacted else "_base" if has_base_suffix else ""
    return f"{basename}_{resolution:02}{kind}" + (f"_tmp{temporary}" if temporary else "")


def parse_table_name(name: str) -> Table | None:
    """The parts of a name; without a suffix it is a base table; None for other tables."""
    m = _NAME.fullmatch(name)
    return m and Table(m[1], int(m[2]), m[4] == "compacted", m[6], m[4] is not None)


@dataclasses.dataclass
class TableSet:
    basename: str
    base: dict[int, Table] = dataclasses.field(default_factory=dict)
    compacted: dict[int, Table] = dataclasses.field(default_factory=dict)
    #: Columns of one name and type in all tables, with their types; hidden and cell columns are left out.
    columns: dict[str, str] = dataclasses.field(default_factory=dict)

    @property
    def base_resolutions(self) -> list[int]:
        return sorted(self.base)

    @property
    def compacted_resolutions(self) -> list[int]:
        return sorted(self.compacted)

    @property
    def base_tables(self) -> list[Table]:
        return [self.base[r] for r in self.base_resolutions]

    @property
    def compacted_tables(self) -> list[Table]:
        return [self.compacted[r] for r in self.compacted_resolutions]

    @property
    def tables(self) -> list[Table]:
        return self.base_tables + self.compacted_tables

    @property
    def num_tables(self) -> int:
        return len(self.base) + len(self.compacted)

    def tables_to_satisfy_query(self, resolution: int) -> list[Table]:
        """The base table of the resolution and all compacted ones up to it."""
        if resolution not in self.base:
            raise UnsupportedResolution(f"tableset {self.basename} has no base resolution {resolution}")
        return [self.base[resolution]] + [t for t in self.compacted_tables if t.resolution <= resolution]


def find_tablesets(names: list[str]) -> dict[str, TableSet]:
    """Tables grouped by their base name; staging and other tables are ignored."""
    out: dict[str, TableSet] = {}
    for n in names:
        t = parse_table_name(n)
        if t and not t.temporary_key:
            s = out.setdefault(t.basename, TableSet(t.basename))
            (s.compacted if t.is_compacted else s.base)[t.resolution] = t
    return out


def usable_columns(tables: list[list[tuple[str, str]]]) -> dict[str, str]:
    """Columns that every table has with one type, from the (name, type) lists of the tables."""
    seen = Counter(c for t in tables for c in t if not c[0].startswith(CELL_COLUMN))
    return dict(sorted(c for c, n in seen.items() if n == len(tables)))
