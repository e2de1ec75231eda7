"""What an operator must know about a table: its columns, their kinds and roles."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DatasetSpec:
    """Columns of a micro-data table with one row a person.

    ``numeric`` and ``categorical`` split ``columns``; ``qid`` are the
    quasi-identifiers and ``sensitive`` the attributes an attacker is after.
    ``domains`` forces the range of a numeric column.
    """

    name: str
    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    qid: tuple[str, ...]
    sensitive: tuple[str, ...] = ()
    domains: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for role in ("numeric", "qid", "sensitive"):
            if unknown := set(getattr(self, role)) - set(self.columns):
                raise ValueError(f"{role}: unknown columns {sorted(unknown)}")
        if bad := [c for c, (lo, hi) in self.domains.items() if c not in self.numeric or lo >= hi]:
            raise ValueError(f"domains: {bad}")

    @property
    def categorical(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.numeric)

    @property
    def other(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.qid)
