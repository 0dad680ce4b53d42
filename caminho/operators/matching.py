"""Matching input rows against the reference tables: single stages, and all stages in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import renumber
from ..functions.standardize import ambiguous_street
from ..plans.stages import STAGES, STATE_KEYS, Stage
from ..sources.store import stored

#: Columns of a candidate besides row_id.
CANDIDATE = ["rank", "lat", "lon", "endereco_encontrado", "desvio_metros", "contagem_cnefe", "log_causa_confusao", "logradouro_encontrado", "numero_encontrado", "cep_encontrado", "localidade_encontrada", "municipio_encontrado", "estado_encontrado", "similaridade_logradouro", "cod_setor"]


def _t(name: str) -> Column:
    return F.col(f"t.{name}")


def _payload(columns: list[str]) -> list[Column]:
    """What a joined reference row tells; missing keys are null."""
    found = lambda name, kind="string": _t(name) if name in columns else F.lit(None).cast(kind)
    return [
        found("lat", "double").alias("lat"),
        found("lon", "double").alias("lon"),
        _t("endereco_completo").alias("endereco_encontrado"),
        _t("desvio_metros").alias("desvio_metros"),
        _t("n_casos").alias("contagem_cnefe"),
        F.col("x.log_causa_confusao").alias("log_causa_confusao"),
        found("logradouro").alias("logradouro_encontrado"),
        found("numero", "int").alias("numero_encontrado"),
        found("cep").alias("cep_encontrado"),
        found("localidade").alias("localidade_encontrada"),
        _t("municipio").alias("municipio_encontrado"),
        _t("estado").alias("estado_encontrado"),
        F.col("x.similaridade").alias("similaridade_logradouro"),
        _t("cod_setor").alias("cod_setor"),
    ]


def interpolated(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` and address with the number asked for: the mean of the candidates'
    points, weighted by the inverse distance of their house numbers. Candidates with the very
    number, if there are any, count alone. Deviations are averaged and rounded half to even."""
    address = renumber(F.col("endereco_encontrado"), F.col("_numero"))
    apart = F.abs(F.col("numero_encontrado") - F.col("_numero"))
    rows = candidates.withColumns({"endereco_encontrado": address, "_w": F.try_divide(F.lit(1.0), apart.cast("double"))})
    exact = F.max((apart == 0).cast("int")) == 1
    mean = lambda c: F.when(exact, F.avg(F.when(apart == 0, F.col(c)))).otherwise(F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")))
    rest = [c for c in CANDIDATE if c not in ("rank", "lat", "lon", "endereco_encontrado", "desvio_metros", "numero_encontrado")]
    return rows.groupBy(*keys, "rank", "endereco_encontrado").agg(
        mean("lat").alias("lat"),
        mean("lon").alias("lon"),
        F.rint(F.avg("desvio_metros")).cast("int").alias("desvio_metros"),
        F.min("_numero").alias("numero_encontrado"),
        *[F.min(c).alias(c) for c in rest],
    )


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns the matchers expect, where they are missing."""
    more = {
        "log_causa_confusao": ambiguous_street(F.col("logradouro")),
        "similar": F.lit(None).cast("string"),
        "similaridade": F.lit(None).cast("decimal(5,3)"),
        "level": F.lit(None).cast("int"),
    }
    return rows.withColumns({k: v for k, v in more.items() if k not in rows.columns})


def _street_ok(stage: Stage) -> Column:
    """Whether a row's similar street has been found by the time of a fuzzy stage: with a
    house number all attempts are made before the street stages, else one with each."""
    step = int(stage.code[-2:])
    made = F.col("level") <= step
    return F.col("numero").isNotNull() | made if "numero" not in stage.keys else made


def stage_matches(rows: DataFrame, table: DataFrame, stage: Stage) -> DataFrame:
    """Candidates of one stage, as it stands in the cascade's definition; an equality join on its keys."""
    rows = prepared(rows)
    fuzzy, near = stage.matcher.startswith("fuzzy"), stage.matcher.endswith("interpolate")
    x = rows.where(reduce(lambda a, k: a & F.col(k).isNotNull(), [*STATE_KEYS, *stage.keys], F.lit(True)))
    if fuzzy:
        x = x.where(F.col("similar").isNotNull() & _street_ok(stage)).withColumn("logradouro", F.col("similar"))
    else:
        x = x.withColumn("similaridade", F.lit(None).cast("decimal(5,3)"))
    on = [k for k in (*STATE_KEYS, *stage.keys) if not (near and k == "numero")]
    joined = x.alias("x").join(table.alias("t"), [F.col(f"x.{k}") == _t(k) for k in on])
    found = joined.select(F.col("x.row_id").alias("row_id"), F.col("x.numero").alias("_numero"), F.lit(stage.rank).alias("rank"), *_payload(table.columns))
    found = interpolated(found, ["row_id"]) if near else found
    return found.select("row_id", *CANDIDATE)


def by_stages(rows: DataFrame, tables: dict[str, DataFrame], stages: list[Stage] = STAGES) -> DataFrame:
    """The cascade as defined: stage after stage, matched rows leaving after each. The tests
    hold the collapsed form against a few stages of it; its plan doubles with every stage."""
    left, found = prepared(rows), []
    for stage in stages:
        found.append(stage_matches(left, tables[stage.table], stage))
        left = left.join(found[-1].select("row_id").distinct(), "row_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def _street(stage: Stage) -> tuple[str, ...]:
    """The keys on which a stage joins, besides state and city."""
    return tuple(k for k in stage.keys if not (k == "numero" and stage.matcher.endswith("interpolate")))


def _served(name: str) -> dict[tuple[tuple[str, ...], bool], list[Stage]]:
    """The stages of a reference table by what they join on and whether they interpolate: those
    on the street given and those on the similar street share a join."""
    found: dict[tuple[tuple[str, ...], bool], list[Stage]] = {}
    for s in STAGES:
        if s.table == name:
            found.setdefault((_street(s), s.matcher.endswith("interpolate")), []).append(s)
    return found


def _on(keys: tuple[str, ...]) -> list[Column]:
    return [F.col("x._street" if k == "logradouro" else f"x.{k}") == _t(k) for k in (*STATE_KEYS, *keys)]


def _first_stage(both: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """row_id and the least rank of the stages that find the row's keys; semi-joins on the
    different keys of each table, so that no candidate of a later stage is made. The ranks of a
    table are stored before the next is read."""
    found = []
    for name, table in tables.items():
        parts = []
        for (keys, near), stages in _served(name).items():
            rank = F.lit(None).cast("int")
            for s in reversed(stages):
                fuzzy = s.matcher.startswith("fuzzy")
                ok = F.col("_fuzzy") == F.lit(fuzzy)
                ok = ok & _street_ok(s) if fuzzy else ok
                ok = ok & F.col("numero").isNotNull() if near else ok
                rank = F.when(ok, F.lit(s.rank)).otherwise(rank)
            names = [*STATE_KEYS, *["_street" if k == "logradouro" else k for k in keys]]
            asked = both.select("row_id", rank.alias("rank"), *names).where(reduce(lambda a, k: a & F.col(k).isNotNull(), names, F.col("rank").isNotNull()))
            known = table.select(*STATE_KEYS, *keys).distinct()
            parts.append(asked.alias("x").join(known.alias("t"), _on(keys), "left_semi").select("row_id", "rank"))
        found.append(stored(reduce(DataFrame.union, parts).groupBy("row_id").agg(F.min("rank").alias("rank"))))
    return reduce(DataFrame.union, found).groupBy("row_id").agg(F.min("rank").alias("rank"))


def _exact(x: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    found = x.alias("x").join(table.alias("t"), _on(keys))
    return found.select(F.col("x.row_id").alias("row_id"), F.col("x.rank").alias("rank"), *_payload(table.columns)).select("row_id", *CANDIDATE)


def _nearby(x: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As interpolated, with the reference rows of one key and address gathered before the join:
    a row then meets each address once, and its mean is taken within that row."""
    on = [*STATE_KEYS, *keys]
    known = table.join(x.select(*STATE_KEYS, *["_street" if k == "logradouro" else k for k in keys]).toDF(*on).distinct(), on, "left_semi")
    rest = [c for c in table.columns if c not in {*on, "numero", "lat", "lon", "endereco_completo", "desvio_metros"}]
    house = F.struct(F.col("numero").alias("n"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    known = known.withColumn("endereco_completo", renumber(F.col("endereco_completo"), F.lit(0))).groupBy(*on, "endereco_completo").agg(
        F.collect_list(house).alias("houses"), F.rint(F.avg("desvio_metros")).cast("int").alias("desvio_metros"), *[F.min(c).alias(c) for c in rest]
    )
    joined = x.alias("x").join(known.alias("t"), _on(keys))
    apart = lambda h: F.abs(h["n"] - F.col("x.numero"))
    # Sums over the houses: with the very number (count, lat, lon), and by inverse distance (weight, lat, lon).
    sums = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "y", "x", "w", "wy", "wx")])

    def add(s: Column, h: Column) -> Column:
        same = F.when(apart(h) == 0, 1.0).otherwise(0.0)
        w = F.when(apart(h) > 0, F.lit(1.0) / apart(h).cast("double")).otherwise(0.0)
        plus = lambda old, factor, c: (s[old] + (factor if c is None else F.coalesce(factor * h[c], F.lit(0.0)))).alias(old)
        return F.struct(plus("n", same, None), plus("y", same, "lat"), plus("x", same, "lon"), plus("w", w, None), plus("wy", w, "lat"), plus("wx", w, "lon"))

    found = joined.select(F.col("x.row_id").alias("row_id"), F.col("x.numero").alias("_numero"), F.col("x.rank").alias("rank"), F.aggregate(_t("houses"), sums, add).alias("_s"), *_payload([c for c in table.columns if c not in ("lat", "lon", "numero")]))
    mean = lambda c: F.when(F.col("_s.n") > 0, F.col(f"_s.{c}") / F.col("_s.n")).otherwise(F.try_divide(F.col(f"_s.w{c}"), F.col("_s.w")))
    new = {"lat": mean("y"), "lon": mean("x"), "endereco_encontrado": renumber(F.col("endereco_encontrado"), F.col("_numero")), "numero_encontrado": F.col("_numero")}
    return found.withColumns(new).select("row_id", *CANDIDATE)


def collapsed(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The same candidates as by_stages, without a pass for each stage.

    A row's answer is all candidates of its least rank. So the rank is found first, by the keys
    alone, and stored with the row; then each row meets one table, on all keys of its stage.
    What a table tells is stored before the next is read: the disk holds the shuffles of one.
    """
    x = prepared(rows)
    plain = x.withColumns({"_street": F.col("logradouro"), "_fuzzy": F.lit(False)})
    alike = x.where("similar is not null").withColumns({"_street": F.col("similar"), "_fuzzy": F.lit(True)})
    first = _first_stage(plain.unionByName(alike), tables)
    fuzzy = F.col("rank").isin(*[s.rank for s in STAGES if s.matcher.startswith("fuzzy")])
    ranked = x.join(first, "row_id").withColumns({"_street": F.when(fuzzy, F.col("similar")).otherwise(F.col("logradouro")), "similaridade": F.when(fuzzy, F.col("similaridade"))})
    ranked = stored(ranked.select("row_id", "rank", *STATE_KEYS, "_street", "numero", "cep", "localidade", "log_causa_confusao", "similaridade"))
    found = []
    for name, table in tables.items():
        parts = []
        for (keys, near), stages in _served(name).items():
            own = ranked.where(F.col("rank").isin(*[s.rank for s in stages]))
            parts.append((_nearby if near else _exact)(own, table, keys))
        found.append(stored(reduce(DataFrame.unionByName, parts)))
    return reduce(DataFrame.unionByName, found)
