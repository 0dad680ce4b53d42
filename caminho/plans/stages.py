"""The match cascade as data."""

from __future__ import annotations

from dataclasses import dataclass

STATE_KEYS = ("estado", "municipio")


@dataclass(frozen=True)
class Stage:
    """One stage: its keys besides state and city, reference table, and how it matches."""

    rank: int
    code: str
    keys: tuple[str, ...]
    table: str
    matcher: str  # exact, interpolate, fuzzy or fuzzy_interpolate
    cutoff: float | None
    precision: str


TABLES = {
    "T1": ("logradouro", "numero", "cep", "localidade"),
    "T2": ("logradouro", "numero", "localidade"),
    "T3": ("logradouro", "cep", "localidade"),
    "T4": ("logradouro", "localidade"),
    "T5": ("cep", "localidade"),
    "T6": ("cep",),
    "T7": ("localidade",),
    "T8": (),
}


def file_name(table: str) -> str:
    """Name of a reference table's file, made of its keys."""
    return "_".join(("municipio", *TABLES[table]))


def _stages() -> list[Stage]:
    number = {"01": ("logradouro", "numero", "cep", "localidade"), "02": ("logradouro", "numero", "cep"), "03": ("logradouro", "numero", "localidade"), "04": ("logradouro", "numero")}
    cutoffs = {"01": 0.85, "02": 0.9, "03": 0.9}
    found: list[tuple] = []
    for step, keys in number.items():
        for letters, matcher in (("dn", "exact"), ("da", "interpolate"), ("pn", "fuzzy"), ("pa", "fuzzy_interpolate")):
            fuzzy = matcher.startswith("fuzzy")
            if fuzzy and step == "04":  # too many candidates for what it finds
                continue
            table = "T2" if step == "04" or (step == "03" and matcher.endswith("interpolate")) else "T1"
            found.append((letters + step, keys, table, matcher, cutoffs[step] if fuzzy else None, "numero_aproximado" if letters[1] == "a" else "numero"))
    for step, keys in number.items():
        rest = tuple(k for k in keys if k != "numero")
        table = "T4" if step == "04" else "T3"
        found.append((f"dl{step}", rest, table, "exact", None, "logradouro"))
        if step in cutoffs:
            found.append((f"pl{step}", rest, table, "fuzzy", cutoffs[step], "logradouro"))
    found += [
        ("dc01", ("cep", "localidade"), "T5", "exact", None, "cep"),
        ("dc02", ("cep",), "T6", "exact", None, "cep"),
        ("db01", ("localidade",), "T7", "exact", None, "localidade"),
        ("dm01", (), "T8", "exact", None, "municipio"),
    ]
    return [Stage(k, *x) for k, x in enumerate(found, 1)]


STAGES = _stages()
BY_CODE = {s.code: s for s in STAGES}

#: The fuzzy attempts in the order in which a row tries them: name, block keys, dictionary table, cutoff.
ATTEMPTS = (("a", ("cep", "localidade"), "T3", 0.85), ("b", ("cep",), "T3", 0.9), ("c", ("localidade",), "T4", 0.9))
