"""Which input columns hold which address fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from .errors import ArgumentError

_COLUMN = re.compile(r"[A-Za-z0-9_]+")


@dataclass(frozen=True, kw_only=True)
class AddressFields:
    """Column names of the six address fields; state and city are mandatory."""

    estado: str
    municipio: str
    logradouro: str | None = None
    numero: str | None = None
    cep: str | None = None
    localidade: str | None = None

    def __post_init__(self):
        given = {f.name: getattr(self, f.name) for f in fields(self)}
        for name in ("estado", "municipio"):
            if not given[name]:
                raise ArgumentError(f"{name} is mandatory")
        used = [v for v in given.values() if v is not None]
        if not all(isinstance(v, str) for v in used):
            raise ArgumentError("fields are named by strings")
        if len(set(used)) != len(used):
            raise ArgumentError("a column can hold one field only")

    def given(self) -> dict[str, str]:
        """field: column, of the fields that are there."""
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def check(self, columns: list[str]) -> None:
        """Raise unless all columns exist and all column names are plain."""
        missing = [v for v in self.given().values() if v not in columns]
        if missing:
            raise ArgumentError(f"no such column: {', '.join(missing)}")
        odd = [c for c in columns if not _COLUMN.fullmatch(c)]
        if odd:
            raise ArgumentError(f"column names need letters, digits and _ only: {', '.join(odd)}")
