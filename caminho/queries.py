"""Queries over the star-schema test tables, one or more per operator, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fields import AddressFields
from .functions import geo, standardize
from .functions.geo import haversine_m, renumber, utm_forward, utm_inverse
from .functions.h3 import h3_cell
from .functions.similarity import jaro_similarity
from .operators import fuzzy, lattice, matching, spatial, ties
from .plans import cep, geocode, reverse
from .plans.stages import ATTEMPTS, BY_CODE, STAGES, STATE_KEYS, TABLES, Stage
from .sources.addresses import INPUT_SQL, POINTS_SQL, input_rows, read, register_points
from .sources.store import ReferenceStore, scratch, stored

ORDER_SQL = "contagem_cnefe DESC NULLS LAST, desvio_metros NULLS LAST, endereco_encontrado NULLS LAST, lat NULLS LAST, lon NULLS LAST"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6378137.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def _table_sql(name: str) -> str:
    keys = [*STATE_KEYS, *TABLES[name]]
    k = ", ".join(keys)
    street = "logradouro" if "logradouro" in keys else "''"
    number = "concat(', ', CAST(numero AS VARCHAR))" if "numero" in keys else ("', 0'" if "logradouro" in keys else "''")
    place = "concat(' - ', localidade)" if "localidade" in keys else "''"
    code = "concat(', ', cep)" if "cep" in keys else "''"
    return f"""{name}a AS (SELECT {k}, avg(lat) AS _lat, avg(lon) AS _lon FROM pts GROUP BY {k}),
{name}b AS (SELECT pts.*, round({_hav("lat", "lon", "_lat", "_lon")}, 2) AS _d FROM pts JOIN {name}a USING ({k})),
{name}c AS (SELECT {k}, quantile_cont(_d, 0.95) AS _p FROM {name}b GROUP BY {k}),
{name} AS (SELECT {k}, avg(lat) FILTER (_d <= _p + 0.01) AS lat, avg(lon) FILTER (_d <= _p + 0.01) AS lon, CAST(round_even(any_value(_p), 0) AS INTEGER) AS desvio_metros,
  CAST(count(*) AS INTEGER) AS n_casos, CASE WHEN min(setor) = max(setor) THEN min(setor) END AS cod_setor,
  concat({street}, {number}, {place}, ', ', municipio, ' - ', estado, {code}) AS endereco_completo FROM {name}b JOIN {name}c USING ({k}) GROUP BY {k})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([POINTS_SQL, INPUT_SQL, *parts]) + "\n"


# Fixed values, spelled out here so that the SQL does not share the package's own.
_CODES_PATTERN = "^(RUA|TRAVESSA|RAMAL|BECO|BLOCO|AVENIDA|RODOVIA|ESTRADA)\\s+([A-Z]{1,2}-?|[0-9]{1,3}|[A-Z]{1,2}-?[0-9]{1,3}|[A-Z]{1,2}\\s+[0-9]{1,3}|[0-9]{1,3}-?[A-Z]{1,2})(\\s+KM( \\d+)?)?$"
_SPELLED_PATTERN = "(RUA UM|RUA DOIS|RUA TRES|RUA CINCO|RUA SEIS|RUA SETE|RUA OITO|RUA NOVE|RUA DEZ|RUA ONZE|RUA DOZE|RUA TREZE)$"
_MONTH_PATTERN = "\\bDE (JANEIRO|FEVEREIRO|MARCO|ABRIL|MAIO|JUNHO|JULHO|AGOSTO|SETEMBRO|OUTUBRO|NOVEMBRO|DEZEMBRO)\\b"
_SPELLED_TIE_PATTERN = "RUA (QUATRO|QUATORZE|QUINZE|DEZESSEIS|DEZESSETE|DEZOITO|DEZENOVE|VINTE|TRINTA|QUARENTA|CINQUENTA|SESSENTA|SETENTA|OITENTA|NOVENTA)"


def _ambiguous_sql(name: str) -> str:
    return f"coalesce((regexp_matches({name}, '{_CODES_PATTERN}') OR regexp_matches({name}, '{_SPELLED_PATTERN}')) AND NOT regexp_matches({name}, '{_MONTH_PATTERN}'), false)"


def _attempt_sql(name: str, block: tuple[str, ...], table: str, cutoff: float) -> str:
    keys = ", ".join([*STATE_KEYS, *block])
    on = " AND ".join(f"x.{k} = d.{k}" for k in (*STATE_KEYS, *block))
    return f"""try_{name}_s AS (SELECT row_id, d.logradouro AS street, CAST(jaro_similarity(x.logradouro, d.logradouro) AS DECIMAL(5,3)) AS sim
  FROM inp x JOIN (SELECT DISTINCT {keys}, logradouro FROM {table}) d ON {on} WHERE x.logradouro IS NOT NULL AND NOT {_ambiguous_sql("x.logradouro")}),
try_{name} AS (SELECT row_id, street, sim FROM try_{name}_s WHERE sim > {cutoff} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, street) = 1)"""


def _rows_sql() -> str:
    names = [f"try_{a[0]}" for a in ATTEMPTS]
    pick = lambda c: ", ".join(f"{n}.{c}" for n in names)
    joins = " ".join(f"LEFT JOIN {n} ON {n}.row_id = i.row_id" for n in names)
    level = " ".join(f"WHEN {n}.street IS NOT NULL THEN {k}" for k, n in enumerate(names, 1))
    return ",\n".join(_attempt_sql(*a) for a in ATTEMPTS) + f""",
x AS (SELECT i.*, coalesce({pick("street")}) AS alike, coalesce({pick("sim")}) AS similaridade, CASE {level} END AS level, {_ambiguous_sql("i.logradouro")} AS log_causa_confusao FROM inp i {joins})"""


def _stage_sql(s: Stage) -> str:
    like, near = s.matcher.startswith("fuzzy"), s.matcher.endswith("interpolate")
    on = [f"x.{k} = t.{k}" for k in STATE_KEYS]
    for k in s.keys:
        if k == "logradouro":
            on.append(f"x.{'alike' if like else k} = t.logradouro")
        else:
            on.append("x.numero IS NOT NULL" if near and k == "numero" else f"x.{k} = t.{k}")
    if like:
        step = int(s.code[-2:])
        on += ["x.logradouro IS NOT NULL", f"x.level <= {step}" if "numero" in s.keys else f"(x.numero IS NOT NULL OR x.level <= {step})"]
    sim = "x.similaridade" if like else "NULL"
    has = lambda k: f"t.{k}" if k in TABLES[s.table] else "NULL"
    source = f"FROM x JOIN {s.table} t ON {' AND '.join(on)}"
    if not near:
        return f"""SELECT x.row_id, {s.rank} AS rank, t.lat, t.lon, t.endereco_completo AS endereco_encontrado, t.desvio_metros, t.n_casos AS contagem_cnefe, x.log_causa_confusao,
  {has("logradouro")} AS logradouro_encontrado, CAST({has("numero")} AS INTEGER) AS numero_encontrado, CAST({sim} AS DECIMAL(5,3)) AS similaridade_logradouro, t.cod_setor {source}"""
    mean = lambda c: f"CASE WHEN max(CAST(t.numero = x.numero AS INTEGER)) = 1 THEN avg(t.{c}) FILTER (t.numero = x.numero) ELSE sum(t.{c} / nullif(CAST(abs(t.numero - x.numero) AS DOUBLE), 0)) / sum(1.0 / nullif(CAST(abs(t.numero - x.numero) AS DOUBLE), 0)) END"
    address = "regexp_replace(t.endereco_completo, ', \\d+ -', concat(', ', CAST(x.numero AS VARCHAR), ' -'))"
    return f"""SELECT x.row_id, {s.rank} AS rank, {mean("lat")} AS lat, {mean("lon")} AS lon, {address} AS endereco_encontrado, CAST(round_even(avg(t.desvio_metros), 0) AS INTEGER) AS desvio_metros,
  min(t.n_casos) AS contagem_cnefe, bool_or(x.log_causa_confusao) AS log_causa_confusao, min(t.logradouro) AS logradouro_encontrado, min(x.numero) AS numero_encontrado,
  CAST(min({sim}) AS DECIMAL(5,3)) AS similaridade_logradouro, min(t.cod_setor) AS cod_setor {source} GROUP BY x.row_id, {address}"""


def _cascade_sql() -> str:
    return ",\n".join(map(_table_sql, TABLES)) + ",\n" + _rows_sql() + ",\nc AS (" + "\nUNION ALL ".join(map(_stage_sql, STAGES)) + ")"


CANDIDATES_SQL = "k AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY row_id) AS _least FROM c) WHERE rank = _least)"
TIES_SQL = f"""w AS (SELECT *, count(*) OVER (PARTITION BY row_id) > 1 AS tied, {_hav("lat", "lon", "lead(lat) OVER o", "lead(lon) OVER o")} AS d FROM k WINDOW o AS (PARTITION BY row_id ORDER BY {ORDER_SQL})),
l AS (SELECT * EXCLUDE (tied, d), CASE WHEN tied THEN d END AS dist, tied FROM w),
v AS (SELECT *, count(*) OVER (PARTITION BY row_id) > 1 AS empate, max(dist) OVER (PARTITION BY row_id) AS _most FROM l WHERE NOT tied OR dist IS NULL OR dist > 300),
e AS (SELECT *, empate AND coalesce(_most > 1000 OR log_causa_confusao OR coalesce(regexp_matches(logradouro_encontrado, '{_SPELLED_TIE_PATTERN}'), false), false)
  AND NOT coalesce(regexp_matches(logradouro_encontrado, '{_MONTH_PATTERN}'), false) AS lost FROM v),
f AS (SELECT *, bool_or(lost) OVER (PARTITION BY row_id) AS gone FROM e),
r AS (SELECT * FROM f WHERE NOT empate
  UNION ALL SELECT * FROM f WHERE lost QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {ORDER_SQL}) = 1
  UNION ALL SELECT * REPLACE (sum(lat * contagem_cnefe) OVER p / nullif(sum(contagem_cnefe) OVER p, 0) AS lat, sum(lon * contagem_cnefe) OVER p / nullif(sum(contagem_cnefe) OVER p, 0) AS lon)
  FROM f WHERE empate AND NOT gone WINDOW p AS (PARTITION BY row_id) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {ORDER_SQL}) = 1)"""


def _rounded(name: str):
    """Six decimals; the shift keeps means that end in a five from rounding differently by engine."""
    return F.round(F.col(name) + 1.23e-8, 6)


_STORES: dict[tuple[str, str], ReferenceStore] = {}


class _Case:
    """Tables that the queries share, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.points = register_points(spark, sf_dir)
        self.rows = input_rows(self.points)

    def table(self, name: str) -> DataFrame:
        return lattice.build(self.points, name)

    def tables(self) -> dict[str, DataFrame]:
        """The eight tables as stored ones, which is how they are meant to be read; built once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORES:
            store = ReferenceStore(scratch(self.spark))
            store.write(lattice.lattice(stored(lattice.counted(self.points))))
            _STORES[key] = store
        store = _STORES[key]
        return {name: store.read(self.spark, name) for name in TABLES}

    def input(self) -> DataFrame:
        """The input rows, stored."""
        return stored(self.rows)


def _places(df: DataFrame, *more: str) -> DataFrame:
    return df.select("row_id", "rank", _rounded("lat").alias("lat"), _rounded("lon").alias("lon"), "endereco_encontrado", "desvio_metros", "contagem_cnefe", *more)


PLACES = "row_id, rank, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, endereco_encontrado, desvio_metros, contagem_cnefe"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(_Case(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _utm_sql(source: str, keys: str) -> str:
    """Tables ending in {source}_xy: ``keys`` of the table ``source`` and the projected x and y of its lat and lon."""
    size, alpha, e = geo._series()
    at = "0.5 * ln((1 + ({0})) / (1 - ({0})))"
    t = f"sinh({at.format('sin(p)')} - {e!r} * {at.format(f'{e!r} * sin(p)')})"
    x = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    y = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return f"""{source}_a AS (SELECT {keys}, radians(lat) AS p, radians(lon + 45.0) AS q FROM {source}), {source}_b AS (SELECT {keys}, q, {t} AS t FROM {source}_a),
{source}_d AS (SELECT {keys}, atan2(t, cos(q)) AS xi, {at.format('sin(q) / sqrt(1 + t * t)')} AS eta FROM {source}_b),
{source}_xy AS (SELECT {keys}, 500000.0 + {geo.SCALE * size!r} * ({x}) AS x, 10000000.0 + {geo.SCALE * size!r} * ({y}) AS y FROM {source}_d)"""


# Whole queries.


@query(_with(_cascade_sql(), CANDIDATES_SQL, TIES_SQL) + """SELECT inp.row_id, inp.logradouro, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, CASE """
       + " ".join(f"WHEN rank = {s.rank} THEN '{s.precision}'" for s in STAGES) + " END AS precisao, CASE " + " ".join(f"WHEN rank = {s.rank} THEN '{s.code}'" for s in STAGES)
       + " END AS tipo_resultado, desvio_metros, endereco_encontrado, contagem_cnefe, CAST(empate AS INTEGER) AS empate, logradouro_encontrado, numero_encontrado FROM inp LEFT JOIN r ON inp.row_id = r.row_id")
def geocode_full(c: _Case) -> DataFrame:
    """The whole cascade with ties resolved, merged to all input rows."""
    found = geocode.match(c.input(), c.tables())
    out = geocode.merge(c.rows.select("row_id", "logradouro"), found, ["lat", "lon", "precisao", "tipo_resultado", "desvio_metros", "endereco_encontrado", "contagem_cnefe", "empate", "logradouro_encontrado", "numero_encontrado"])
    return out.withColumns({"lat": _rounded("lat"), "lon": _rounded("lon"), "empate": F.col("empate").cast("int")})


@query(_with(_cascade_sql(), CANDIDATES_SQL) + f"SELECT {PLACES}, CAST(similaridade_logradouro AS DOUBLE) AS similaridade FROM k")
def geocode_candidates(c: _Case) -> DataFrame:
    """All candidates of each row's first stage that has any."""
    same, addresses = geocode.distinct_addresses(c.input())
    found = same.join(geocode.candidates(addresses, c.tables()).withColumnRenamed("row_id", "_address"), "_address")
    return _places(found, F.col("similaridade_logradouro").cast("double").alias("similaridade"))


_LABEL_SQL = "CASE " + " ".join(f"WHEN rank = {s.rank} THEN '{s.precision}'" for s in STAGES) + " END AS precisao, CASE " + " ".join(f"WHEN rank = {s.rank} THEN '{s.code}'" for s in STAGES) + " END AS tipo_resultado"


def _public(c: _Case, **options) -> DataFrame:
    """The public function on an input that was dealt anew, so that only stored row numbers can hold."""
    rows = c.rows.withColumnRenamed("row_id", "pt").withColumn("numero", F.col("numero").cast("string")).orderBy("pt")
    names = ["estado", "municipio", "logradouro", "numero", "cep", "localidade"]
    out = geocode.geocode(rows, AddressFields(**{n: n for n in names}), c.tables(), **options)
    return out.withColumns({"lat": _rounded("lat"), "lon": _rounded("lon")})


@query(_with(_cascade_sql(), CANDIDATES_SQL, TIES_SQL) + f"SELECT inp.row_id AS pt, inp.logradouro, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, {_LABEL_SQL}, desvio_metros, endereco_encontrado FROM inp LEFT JOIN r ON inp.row_id = r.row_id")
def geocode_public(c: _Case) -> DataFrame:
    """The public function with its short result."""
    return _public(c).select("pt", "logradouro", "lat", "lon", "precisao", "tipo_resultado", "desvio_metros", "endereco_encontrado")


@query(_with(_cascade_sql(), CANDIDATES_SQL) + f"SELECT inp.row_id AS pt, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, {_LABEL_SQL}, endereco_encontrado, CAST(CASE WHEN rank IS NOT NULL THEN coalesce(similaridade_logradouro, 1) END AS DOUBLE) AS similaridade, CASE WHEN rank IS NOT NULL THEN count(*) OVER (PARTITION BY inp.row_id) > 1 END AS empate FROM inp LEFT JOIN k ON inp.row_id = k.row_id")
def geocode_ties_kept(c: _Case) -> DataFrame:
    """The public function with all columns, ties kept."""
    return _public(c, full=True, resolve_ties=False).select("pt", "lat", "lon", "precisao", "tipo_resultado", "endereco_encontrado", F.col("similaridade_logradouro").alias("similaridade"), "empate")


_ASKED = "asked AS (SELECT pt_id, lat - 0.003 AS lat, lon + 0.004 AS lon FROM pts WHERE pt_id % 100 = 0)"
_REACHED = """reached AS (SELECT a.pt_id, t.endereco_completo, sqrt(pow(t.x - a.x, 2) + pow(t.y - a.y, 2)) AS distancia FROM asked_xy a JOIN T1_xy t ON t.x BETWEEN a.x - 2000 AND a.x + 2000 AND t.y BETWEEN a.y - 2000 AND a.y + 2000)"""


@query(_with(_table_sql("T1"), _ASKED, _utm_sql("asked", "pt_id"), _utm_sql("T1", "endereco_completo"), _REACHED) + "SELECT pt_id, round(distancia, 3) AS distancia, endereco_completo FROM reached WHERE distancia <= 2000 QUALIFY row_number() OVER (PARTITION BY pt_id ORDER BY distancia, endereco_completo) = 1")
def reverse_full(c: _Case) -> DataFrame:
    """Nearest address within 2 km of points near register points, on the projection."""
    near = c.points.where("pt_id % 100 = 0").select("pt_id", (F.col("lon") + 0.004).alias("lon"), (F.col("lat") - 0.003).alias("lat"))
    return reverse.reverse_geocode(near, c.table("T1"), 2000).select("pt_id", F.round("distancia", 3).alias("distancia"), "endereco_completo")


_CODES = ["00007-000", "00049000", "99999-999", "banana", "7000"]
_CODES_SQL = "a AS (SELECT * FROM (VALUES ('00007-000'), ('00049-000'), ('99999-999')) v(cep))"


@query(_with(_table_sql("T3"), _CODES_SQL) + "SELECT cep, estado, municipio, logradouro, localidade, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon FROM a LEFT JOIN T3 USING (cep)")
def cep_lookup(c: _Case) -> DataFrame:
    """Streets of postal codes, unknown codes kept."""
    found = cep.lookup(c.spark.createDataFrame([(x,) for x in _CODES], "cep string"), c.table("T3"))
    return found.withColumns({"lat": _rounded("lat"), "lon": _rounded("lon")})


# Sources and predicates.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def scan_filter_parquet(c: _Case) -> DataFrame:
    """Parquet scan with filter and column pruning."""
    return read(c.spark, c.sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_custkey")


@query(_with(_table_sql("T3")) + "SELECT estado, municipio, logradouro, cep, localidade, n_casos FROM T3 WHERE (estado, municipio) IN (SELECT (estado, municipio) FROM inp WHERE numero IS NULL AND cep IS NULL AND localidade = 'BUILDING')")
def lattice_prune(c: _Case) -> DataFrame:
    """The part of a reference table in the input's states and cities."""
    return lattice.prune(c.table("T3"), c.rows.where("numero is null and cep is null and localidade = 'BUILDING'")).select("estado", "municipio", "logradouro", "cep", "localidade", "n_casos")


@query(_with(_table_sql("T3")) + "SELECT DISTINCT estado, municipio, cep, logradouro FROM T3")
def street_dictionary(c: _Case) -> DataFrame:
    """Different streets by block."""
    return lattice.dictionary(c.table("T3"), ("cep",))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(i) AS BIGINT) AS low, CAST(max(i) AS BIGINT) AS high, CAST(count(DISTINCT i) AS BIGINT) AS different FROM (SELECT row_number() OVER () AS i FROM orders)")
def row_id(c: _Case) -> DataFrame:
    """Row numbers from 1 on without gaps."""
    rows = geocode.numbered(read(c.spark, c.sf_dir, "orders").select("o_orderkey"), "i")
    return rows.agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.countDistinct("i").alias("different"))


@query(_with() + "SELECT row_id, logradouro, numero, cep FROM inp WHERE logradouro IS NOT NULL AND numero IS NOT NULL AND cep IS NOT NULL")
def filter_not_null(c: _Case) -> DataFrame:
    """Rows with all keys."""
    return c.rows.dropna(subset=["logradouro", "numero", "cep"]).select("row_id", "logradouro", "numero", "cep")


@query(_with(_table_sql("T7")) + "SELECT row_id FROM inp WHERE NOT EXISTS (SELECT 1 FROM T7 WHERE T7.municipio = inp.municipio AND T7.localidade = inp.localidade)")
def anti_not_exists(c: _Case) -> DataFrame:
    """Rows without a counterpart."""
    return c.rows.join(c.table("T7").select("municipio", "localidade"), ["municipio", "localidade"], "left_anti").select("row_id")


_LABELS = " ".join(f"WHEN k = {s.rank} THEN '{s.precision}'" for s in STAGES)


@query(f"SELECT l_linenumber AS n, k, CASE {_LABELS} END AS precisao, CAST(count(*) AS BIGINT) AS c FROM (SELECT l_linenumber, l_orderkey % 26 AS k FROM lineitem) GROUP BY ALL")
def precision_label(c: _Case) -> DataFrame:
    """Precision by stage."""
    rows = read(c.spark, c.sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 26).alias("k"))
    return rows.groupBy("n", "k").agg(F.count("*").alias("c")).withColumn("precisao", geocode.precision_label(F.col("k")))


_STREETS = "SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'RUA ' WHEN 1 THEN 'AVENIDA ' WHEN 2 THEN 'RODOVIA ' ELSE '' END, CASE p_partkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN '10' WHEN 2 THEN 'BR-364 KM 12' WHEN 3 THEN 'RUA DEZ' WHEN 4 THEN '15 DE NOVEMBRO' WHEN 5 THEN 'BR 116' ELSE CASE p_partkey % 3 WHEN 0 THEN 'MARIA 12' WHEN 1 THEN 'BRASIL 2000' ELSE upper(p_name) END END) AS s, p_partkey FROM part"


@query(f"SELECT p_partkey, s, {_ambiguous_sql('s')} AS ambiguous FROM ({_STREETS})", "ambiguous_street")
def ambiguous_street_query(c: _Case) -> DataFrame:
    """Street names that are codes or numbers."""
    read(c.spark, c.sf_dir, "part").createOrReplaceTempView("_caminho_part")
    rows = c.spark.sql(_STREETS.replace("FROM part", "FROM _caminho_part"))
    return rows.select("p_partkey", "s", standardize.ambiguous_street(F.col("s")).alias("ambiguous"))


# Joins.


def _exact(code: str):
    s = BY_CODE[code]
    sql = _with(_table_sql(s.table), "x AS (SELECT *, CAST(NULL AS VARCHAR) AS alike, CAST(NULL AS DECIMAL(5,3)) AS similaridade, NULL AS level, " + _ambiguous_sql("logradouro") + " AS log_causa_confusao FROM inp)", f"c AS ({_stage_sql(s)})")
    return sql + f"SELECT {PLACES} FROM c"


@query(_exact("dn02"))
def match_exact(c: _Case) -> DataFrame:
    """An exact stage that joins on fewer keys than the table's grain."""
    return _places(matching.stage_matches(c.rows, c.table("T1"), BY_CODE["dn02"]))


@query(_exact("da02"))
def match_interpolate(c: _Case) -> DataFrame:
    """An interpolated stage."""
    return _places(matching.stage_matches(c.rows, c.table("T1"), BY_CODE["da02"]))


def _fuzzy_sql(code: str) -> str:
    s = BY_CODE[code]
    return _with(*[_table_sql(t) for t in sorted({"T3", "T4", s.table})], _rows_sql(), f"c AS ({_stage_sql(s)})") + f"SELECT {PLACES}, CAST(similaridade_logradouro AS DOUBLE) AS similaridade FROM c"


def _fuzzy(c: _Case, code: str) -> DataFrame:
    rows = fuzzy.with_similar_street(c.rows, {"T3": c.table("T3"), "T4": c.table("T4")})
    return _places(matching.stage_matches(rows, c.table(BY_CODE[code].table), BY_CODE[code]), F.col("similaridade_logradouro").cast("double").alias("similaridade"))


@query(_fuzzy_sql("pn01"))
def match_fuzzy_exact(c: _Case) -> DataFrame:
    """A stage on similar streets."""
    return _fuzzy(c, "pn01")


@query(_fuzzy_sql("pa03"))
def match_fuzzy_interpolate(c: _Case) -> DataFrame:
    """An interpolated stage on similar streets."""
    return _fuzzy(c, "pa03")


@query(_with(_table_sql("T3"), _table_sql("T4"), _rows_sql()) + "SELECT row_id, alike, CAST(similaridade AS DOUBLE) AS similaridade, CAST(level AS INTEGER) AS level FROM x WHERE alike IS NOT NULL")
def fuzzy_street(c: _Case) -> DataFrame:
    """Best similar street and the attempt that found it."""
    rows = fuzzy.with_similar_street(c.rows, {"T3": c.table("T3"), "T4": c.table("T4")})
    return rows.where("similar is not null").select("row_id", F.col("similar").alias("alike"), F.col("similaridade").cast("double").alias("similaridade"), "level")


@query(_exact("dn01").replace(f"SELECT {PLACES} FROM c", "SELECT row_id, municipio FROM inp WHERE row_id NOT IN (SELECT row_id FROM c)"))
def cascade_remaining(c: _Case) -> DataFrame:
    """Rows left after the first stage."""
    found = matching.stage_matches(c.rows, c.table("T1"), BY_CODE["dn01"]).select("row_id").distinct()
    return c.rows.join(found, "row_id", "left_anti").select("row_id", "municipio")


@query(_exact("dl02").replace(f"SELECT {PLACES} FROM c", "SELECT inp.row_id, inp.cep, rank, round(lat + 1.23e-8, 6) AS lat, contagem_cnefe FROM inp LEFT JOIN c ON inp.row_id = c.row_id"))
def merge_left(c: _Case) -> DataFrame:
    """All input rows with what was found, ties repeated."""
    found = matching.stage_matches(c.rows, c.table("T3"), BY_CODE["dl02"]).withColumn("lat", _rounded("lat"))
    return geocode.merge(c.rows.select("row_id", "cep"), found, ["rank", "lat", "contagem_cnefe"])


_BOX = "b AS (SELECT municipio AS area, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM pts GROUP BY municipio)"


@query(_with(_BOX) + "SELECT DISTINCT pt_id, area FROM pts JOIN b ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax")
def bbox_range_join(c: _Case) -> DataFrame:
    """Areas whose box holds a point."""
    areas = spatial.boxes(c.points.withColumnRenamed("municipio", "area"), ["area"])
    return spatial.within_boxes(c.points.select("pt_id", "lon", "lat"), areas).select("pt_id", "area").distinct()


@query(_with() + "SELECT round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax, min(lon) >= -73.99044997 AND max(lon) <= -28.83594354 AND min(lat) >= -33.75208127 AND max(lat) <= 5.27184108 AS inside FROM pts")
def bbox_guard(c: _Case) -> DataFrame:
    """Extent of the points and whether it is covered."""
    return spatial.extent(c.points).withColumns({k: F.round(k, 6) for k in ("xmin", "ymin", "xmax", "ymax")})


_NEAR = f"n AS (SELECT p.pt_id AS row_id, q.pt_id AS found, {_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS distancia FROM pts p JOIN pts q ON {_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 400 WHERE p.pt_id % 100 = 0)"


def _near(c: _Case) -> DataFrame:
    asked = c.points.where("pt_id % 100 = 0").select(F.col("pt_id").alias("row_id"), "lon", "lat")
    return spatial.within_radius(asked, c.points.select(F.col("pt_id").alias("found"), "lon", "lat"), 400, spherical=True)


@query(_with(_NEAR) + "SELECT row_id, found, round(distancia, 2) AS distancia FROM n")
def radius_join(c: _Case) -> DataFrame:
    """All addresses within 400 m."""
    return _near(c).select("row_id", "found", F.round("distancia", 2).alias("distancia"))


@query(_with(_NEAR) + "SELECT row_id, found, round(distancia, 2) AS distancia FROM n WHERE row_id <> found QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(distancia, 4), found) = 1")
def nearest_one(c: _Case) -> DataFrame:
    """The nearest other address."""
    pairs = _near(c).where("row_id <> found").withColumn("distancia", F.round("distancia", 4))
    return spatial.nearest(pairs, ["found"]).select("row_id", "found", F.round("distancia", 2).alias("distancia"))


# Aggregations.


@query(_with() + "SELECT estado, municipio, logradouro, round(sum(lat / (numero + 1000 - 500)) / sum(1.0 / (numero + 1000 - 500)), 6) AS lat FROM pts GROUP BY ALL")
def interp_idw(c: _Case) -> DataFrame:
    """Mean weighted by inverse distance."""
    w = F.try_divide(F.lit(1.0), F.abs(F.col("numero") + 500).cast("double"))
    return c.points.groupBy("estado", "municipio", "logradouro").agg(F.round(F.try_divide(F.sum(F.col("lat") * w), F.sum(w)), 6).alias("lat"))


for _name in TABLES:
    _k = ", ".join([*STATE_KEYS, *TABLES[_name]])
    ORACLE_SQL[f"lattice_build_{_name.lower()}"] = _with(_table_sql(_name)) + f"SELECT {_k}, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, desvio_metros, n_casos, cod_setor, endereco_completo FROM {_name}"
    QUERIES[f"lattice_build_{_name.lower()}"] = lambda spark, sf_dir, name=_name: _Case(spark, sf_dir).table(name).withColumns({"lat": _rounded("lat"), "lon": _rounded("lon")})


# Ties, on the candidates of one stage that has many.

_TIED = _exact("dl02").rpartition("SELECT")[0] + ", k AS (SELECT * FROM c)"
_TIED = _TIED.replace("\n, k AS", ", k AS")


def _tied(c: _Case) -> DataFrame:
    return matching.stage_matches(c.rows, c.table("T3"), BY_CODE["dl02"])


@query(_TIED + " SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT row_id FROM k GROUP BY row_id HAVING count(*) > 1)")
def tie_count(c: _Case) -> DataFrame:
    """Rows with several candidates."""
    return _tied(c).groupBy("row_id").count().where("count > 1").agg(F.count("*").alias("n"))


@query(_TIED + " SELECT row_id, endereco_encontrado, count(*) OVER (PARTITION BY row_id) > 1 AS empate FROM k")
def tie_flag(c: _Case) -> DataFrame:
    """Whether a candidate has rivals."""
    return ties.flagged(_tied(c)).select("row_id", "endereco_encontrado", "empate")


@query(_TIED + f" SELECT row_id, endereco_encontrado, CAST(row_number() OVER (PARTITION BY row_id ORDER BY {ORDER_SQL}) AS INTEGER) AS place FROM k")
def tie_rank(c: _Case) -> DataFrame:
    """Order of preference."""
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(*ties.preferred()))
    return _tied(c).select("row_id", "endereco_encontrado", place.alias("place"))


_DIST = _TIED + "," + TIES_SQL.partition("v AS")[0].rstrip().rstrip(",")


@query(_DIST + " SELECT row_id, endereco_encontrado, round(dist, 2) AS dist FROM l")
def tie_distance(c: _Case) -> DataFrame:
    """Distance to the next preferred candidate."""
    return ties.apart(_tied(c)).select("row_id", "endereco_encontrado", F.round("dist", 2).alias("dist"))


@query(_DIST + " SELECT row_id, round(max(dist), 2) AS most FROM l GROUP BY row_id")
def tie_maxdist(c: _Case) -> DataFrame:
    """Largest distance of a row's candidates."""
    return ties.apart(_tied(c)).groupBy("row_id").agg(F.round(F.max("dist"), 2).alias("most"))


@query(_TIED + f" SELECT row_id, endereco_encontrado, contagem_cnefe FROM k QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {ORDER_SQL}) = 1")
def tie_top1(c: _Case) -> DataFrame:
    """The preferred candidate."""
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(*ties.preferred()))
    return _tied(c).withColumn("_n", place).where("_n = 1").select("row_id", "endereco_encontrado", "contagem_cnefe")


@query(_TIED + " SELECT row_id, endereco_encontrado, round(sum(lat * contagem_cnefe) OVER p / nullif(sum(contagem_cnefe) OVER p, 0), 6) AS lat FROM k WINDOW p AS (PARTITION BY row_id)")
def tie_weighted_mean(c: _Case) -> DataFrame:
    """Mean of a row's candidates weighted by cases."""
    p = Window.partitionBy("row_id")
    mean = F.try_divide(F.sum(F.col("lat") * F.col("contagem_cnefe")).over(p), F.sum("contagem_cnefe").over(p))
    return _tied(c).select("row_id", "endereco_encontrado", F.round(mean, 6).alias("lat"))


@query(_TIED + "," + TIES_SQL + " SELECT row_id, round(lat + 1.23e-8, 6) AS lat, round(lon + 1.23e-8, 6) AS lon, endereco_encontrado, empate FROM r")
def tie_resolve(c: _Case) -> DataFrame:
    """One candidate per row."""
    return ties.resolve(_tied(c)).select("row_id", _rounded("lat").alias("lat"), _rounded("lon").alias("lon"), "endereco_encontrado", "empate")


# Scalar functions.

_PAIRS = "(SELECT a.p_partkey AS i, b.p_partkey AS j, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 3)"


@query(f"SELECT i, j, round(jaro_similarity(x, y), 9) AS s FROM {_PAIRS}")
def jaro(c: _Case) -> DataFrame:
    """Jaro similarity of part names."""
    return _pairs(c).select("i", "j", F.round(jaro_similarity("x", "y"), 9).alias("s"))


def _pairs(c: _Case) -> DataFrame:
    part = read(c.spark, c.sf_dir, "part").select("p_partkey", "p_name")
    a = part.select(F.col("p_partkey").alias("i"), F.col("p_name").alias("x"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 3)).alias("j"))
    return a.join(part.select(F.col("p_partkey").alias("j"), F.col("p_name").alias("y")), "j")


@query(f"SELECT i, j, CAST(CAST(jaro_similarity(x, y) AS DECIMAL(5,3)) AS DOUBLE) AS s FROM {_PAIRS} WHERE CAST(jaro_similarity(x, y) AS DECIMAL(5,3)) > 0.6")
def decimal_round(c: _Case) -> DataFrame:
    """Similarity rounded to three decimals before it is compared."""
    return _pairs(c).select("i", "j", jaro_similarity("x", "y").cast("decimal(5,3)").alias("s")).where("s > 0.6").withColumn("s", F.col("s").cast("double"))


@query(_with(_table_sql("T1")) + r"SELECT endereco_completo, numero, regexp_replace(endereco_completo, ', \d+ -', concat(', ', CAST(numero + 1000 AS VARCHAR), ' -')) AS changed FROM T1")
def renumber_address(c: _Case) -> DataFrame:
    """An address with another house number."""
    return c.table("T1").select("endereco_completo", "numero", renumber(F.col("endereco_completo"), F.col("numero") + 1000).alias("changed"))


@query(_with() + f"SELECT pt_id, round({_hav('lat', 'lon', 'CAST(-20 AS DOUBLE)', 'CAST(-50 AS DOUBLE)')}, 2) AS d FROM pts")
def haversine(c: _Case) -> DataFrame:
    """Great-circle distance to a place."""
    return c.points.select("pt_id", F.round(haversine_m(F.col("lat"), F.col("lon"), F.lit(-20.0), F.lit(-50.0)), 2).alias("d"))


@query(_with(_utm_sql("pts", "pt_id")) + "SELECT pt_id, round(x, 3) AS x, round(y, 3) AS y FROM pts_xy")
def utm_projection(c: _Case) -> DataFrame:
    """Projected coordinates."""
    x, y = utm_forward(F.col("lat"), F.col("lon"))
    return c.points.select("pt_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(_with() + "SELECT pt_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM pts")
def utm_round_trip(c: _Case) -> DataFrame:
    """Coordinates projected and led back."""
    lat, lon = utm_inverse(*utm_forward(F.col("lat"), F.col("lon")))
    return c.points.select("pt_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(name="h3_cells")
def h3_cells_query(c: _Case) -> DataFrame:
    """Hexagonal cells of all register points at two resolutions; the tests hold known ids."""
    return c.points.select("pt_id", h3_cell(F.col("lat"), F.col("lon"), 7).alias("h3_07"), h3_cell(F.col("lat"), F.col("lon"), 9).alias("h3_09"))


@query("SELECT c_custkey, concat(lpad(CAST(c_custkey * 37 % 100000000 AS VARCHAR), 8, '0')[1:5], '-', lpad(CAST(c_custkey * 37 % 100000000 AS VARCHAR), 8, '0')[6:8]) AS cep FROM customer")
def standardize_cep(c: _Case) -> DataFrame:
    """Postal codes in standard form."""
    return read(c.spark, c.sf_dir, "customer").select("c_custkey", standardize.cep((F.col("c_custkey") * 37 % 100000000).cast("string")).alias("cep"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('AVENIDA ', upper(p_name)) WHEN p_partkey % 3 = 1 THEN concat('RUA ', upper(p_name)) ELSE upper(p_name) END AS s FROM part")
def standardize_street(c: _Case) -> DataFrame:
    """Streets with their type written out, in plain capitals."""
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit(" av. ")).when(F.col("p_partkey") % 3 == 1, F.lit("r.  ")).otherwise(F.lit(""))
    return read(c.spark, c.sf_dir, "part").select("p_partkey", standardize.street(F.concat(kind, F.col("p_name"), F.lit(" "))).alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE nullif(l_orderkey % 50, 0) END AS INTEGER) AS n FROM lineitem")
def standardize_number(c: _Case) -> DataFrame:
    """House numbers, odd ones null."""
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat((F.col("l_orderkey") % 50).cast("string"), F.lit("A"))).otherwise((F.col("l_orderkey") % 50).cast("string"))
    return read(c.spark, c.sf_dir, "lineitem").select("l_orderkey", "l_linenumber", standardize.number(text).alias("n"))


_STATE_ROWS = list(standardize.STATES.items())


@query("SELECT i, uf FROM (VALUES " + ", ".join(f"({i}, '{code}')" for i, (_, code) in enumerate(_STATE_ROWS)) + ") v(i, uf)")
def standardize_state(c: _Case) -> DataFrame:
    """State codes from names."""
    rows = [(i, f" {n.lower()} " if i % 2 else code.lower()) for i, (n, code) in enumerate(_STATE_ROWS)]
    return c.spark.createDataFrame(rows, "i int, s string").select("i", standardize.state(F.col("s")).alias("uf"))


# Analysis of results.


@query(_with(_cascade_sql(), CANDIDATES_SQL, TIES_SQL) + "SELECT rank, CAST(count(*) AS BIGINT) AS n, quantile_cont(desvio_metros, 0.5) AS p50, quantile_cont(desvio_metros, 0.9) AS p90 FROM r GROUP BY rank")
def stage_profile(c: _Case) -> DataFrame:
    """Rows and deviation quantiles by stage."""
    found = geocode.match(c.input(), c.tables())
    return found.groupBy("rank").agg(F.count("*").alias("n"), F.percentile("desvio_metros", 0.5).alias("p50"), F.percentile("desvio_metros", 0.9).alias("p90"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full geocoder."""
    return QUERIES["geocode_full"](spark, sf_dir)
