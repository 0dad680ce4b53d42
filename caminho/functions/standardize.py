"""Standard forms of address fields, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The federal units and the usual abbreviations of street types.
STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF", "ESPIRITO SANTO": "ES",
    "GOIAS": "GO", "MARANHAO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG", "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR",
    "PERNAMBUCO": "PE", "PIAUI": "PI", "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR",
    "SANTA CATARINA": "SC", "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}
STREET_TYPES = {"R": "RUA", "AV": "AVENIDA", "TV": "TRAVESSA", "TRAV": "TRAVESSA", "ROD": "RODOVIA", "EST": "ESTRADA", "AL": "ALAMEDA", "PCA": "PRACA", "PC": "PRACA", "LGO": "LARGO", "VL": "VILA", "BC": "BECO"}
_ACCENTED, _PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN"


def plain(text: Column) -> Column:
    """Upper case, no accents, single spaces; blank becomes null."""
    text = F.translate(F.upper(text.cast("string")), _ACCENTED, _PLAIN)
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


def state(text: Column) -> Column:
    """Two-letter code of a state given by name or code."""
    name = plain(text)
    codes = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, name), name)


def street(text: Column) -> Column:
    """Street with its type written out."""
    name = F.regexp_replace(plain(text), "[.,;]+", " ")
    name = F.nullif(F.trim(F.regexp_replace(name, "\\s+", " ")), F.lit(""))
    kinds = F.create_map(*[F.lit(x) for pair in STREET_TYPES.items() for x in pair])
    first, rest = F.regexp_extract(name, "^(\\S+)", 1), F.regexp_extract(name, "^\\S+( .+)$", 1)
    return F.when(rest != "", F.concat(F.coalesce(F.try_element_at(kinds, first), first), rest)).otherwise(name)


def number(text: Column) -> Column:
    """House number as an int; 0, S/N and anything not all digits become null."""
    value = F.when(F.trim(text.cast("string")).rlike("^\\d{1,9}(\\.0)?$"), F.regexp_extract(text.cast("string"), "(\\d+)", 1).cast("int"))
    return F.nullif(value, F.lit(0))


def cep(text: Column) -> Column:
    """Postal code as 00000-000; null unless it has one to eight digits."""
    digits = F.regexp_replace(text.cast("string"), "\\D", "")
    padded = F.lpad(digits, 8, "0")
    return F.when(F.length(digits).between(1, 8), F.concat(F.left(padded, F.lit(5)), F.lit("-"), F.right(padded, F.lit(3))))


# Names of streets that say little, and months, which make such a name a real one.
_TYPES = "RUA|TRAVESSA|RAMAL|BECO|BLOCO|AVENIDA|RODOVIA|ESTRADA"
_MONTHS = "JANEIRO|FEVEREIRO|MARCO|ABRIL|MAIO|JUNHO|JULHO|AGOSTO|SETEMBRO|OUTUBRO|NOVEMBRO|DEZEMBRO"
_SPELLED = "UM|DOIS|TRES|CINCO|SEIS|SETE|OITO|NOVE|DEZ|ONZE|DOZE|TREZE"
CODE_STREET = f"^({_TYPES})\\s+([A-Z]{{1,2}}-?|[0-9]{{1,3}}|[A-Z]{{1,2}}-?[0-9]{{1,3}}|[A-Z]{{1,2}}\\s+[0-9]{{1,3}}|[0-9]{{1,3}}-?[A-Z]{{1,2}})(\\s+KM( \\d+)?)?$"
SPELLED_STREET = f"RUA ({_SPELLED})$"
MONTH_STREET = f"\\bDE ({_MONTHS})\\b"
SPELLED_TIE = "RUA (QUATRO|QUATORZE|QUINZE|DEZESSEIS|DEZESSETE|DEZOITO|DEZENOVE|VINTE|TRINTA|QUARENTA|CINQUENTA|SESSENTA|SETENTA|OITENTA|NOVENTA)"


def ambiguous_street(name: Column) -> Column:
    """Whether a street name is a mere code or number, of which a town may have many; false for null."""
    return F.coalesce((name.rlike(CODE_STREET) | name.rlike(SPELLED_STREET)) & ~name.rlike(MONTH_STREET), F.lit(False))
