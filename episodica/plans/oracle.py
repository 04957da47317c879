"""Independent SQL for the registered queries, in the dialect of the checking engine.

Shared relations are written once and each query takes those it needs as CTEs.
The SQL follows the rules of the tables, not the way the Spark jobs compute them.
"""

from __future__ import annotations

import re

from episodica.functions import vocabulary as V
from episodica.plans import visits as fixture
from episodica.plans.registry import DESCRIBED, HEATMAP_MIN_EPISODES, MIN_EPISODES

_FMT = "'%d/%m/%Y %H:%M:%S'"


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _like_any(text: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({text}, '{f}')" for f in fragments) + ")"


_ATTRS = (
    "sexo", "municipiosolicitante", "municipioresidencia", "municipioexecutante", "executante",
    "especialidade", "tipoleito", "carater", "codigocid", "motivoalta",
)
_ATTR_LIST = ", ".join(_ATTRS)

_ORDER = "admission_ts NULLS LAST, CASE WHEN admission_ts IS NULL THEN md5(datahorainternacao) END, datahorainternacao"
_STAY = "(discharge_ts::DATE - admission_ts::DATE)"
_CHARACTER = "upper(coalesce(next_carater, ''))"
_PLANNING = (
    f"CASE WHEN {_like_any(_CHARACTER, V.ELECTIVE_FRAGMENTS)} THEN '{V.PLANNED}' "
    f"WHEN {_like_any(_CHARACTER, V.URGENT_FRAGMENTS)} THEN '{V.UNPLANNED}' ELSE '{V.UNDETERMINED}' END"
)


def _spans(expr: str, spans, rest: str) -> str:
    """CASE with inclusive upper bounds."""
    arms = " ".join(f"WHEN {expr} <= {upper} THEN '{label}'" for upper, label in spans)
    return f"CASE {arms} ELSE '{rest}' END"


_RELATIONS: dict[str, str] = {
    "orders_at": "SELECT *, o_orderdate + INTERVAL 24 YEAR + to_hours(o_orderkey % 24) AS ts0 FROM orders",
    "visits": f"""
        SELECT o_custkey::VARCHAR AS identificador,
               ts0::DATE - l_linenumber AS datasolicitacao,
               ts0 - to_days(l_linenumber) AS datahorasolicitacao,
               CASE WHEN o_orderkey % 50 = 0 THEN '{V.ADMISSION_SENTINEL}'
                    WHEN o_orderkey % 101 = 0 AND year(ts0) = 2024 THEN strftime(ts0 - INTERVAL 20 YEAR, {_FMT})
                    WHEN o_orderkey % 103 = 0 AND year(ts0) = 2023 THEN strftime(ts0 - INTERVAL 10 YEAR, {_FMT})
                    WHEN o_orderkey % 211 = 0 THEN 'INVALIDA'
                    ELSE strftime(ts0, {_FMT}) END AS datahorainternacao,
               CASE WHEN l_partkey % 29 = 0 THEN '{V.DISCHARGE_SENTINEL}'
                    WHEN l_partkey % 31 = 0 THEN ''
                    WHEN l_partkey % 997 = 0 THEN strftime(ts0 + INTERVAL 400 DAY, {_FMT})
                    ELSE strftime(ts0 + to_days((l_partkey % 13)::INT) + to_hours(l_suppkey % 24), {_FMT})
               END AS datahoraalta,
               o_orderstatus AS situacao,
               {_list(fixture.SEXES)}[o_custkey % 3 + 1] AS sexo,
               rn.n_name AS municipiosolicitante, rn.n_name AS municipioresidencia, pn.n_name AS municipioexecutante,
               s_name AS executante, p_type AS especialidade, l_returnflag AS tipoleito,
               {_list(fixture.CHARACTERS)}[(o_orderkey // 3) % 6 + 1] AS carater,
               {_list(fixture.ICD_CODES)}[o_orderkey % 8 + 1] AS codigocid,
               CASE WHEN o_orderkey % 11 = 0 THEN '{V.DEATH}' WHEN o_orderkey % 13 = 0 THEN '{V.TRANSFER}'
                    WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '{V.ADMINISTRATIVE_CLOSURE}'
                    ELSE 'Alta' END AS motivoalta,
               {_list(fixture.PROCEDURES)}[(o_orderkey // 8) % 9 + 1] AS procedimentosolicitado
        FROM lineitem JOIN orders_at ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation pn ON s_nationkey = pn.n_nationkey
        JOIN customer ON o_custkey = c_custkey JOIN nation rn ON c_nationkey = rn.n_nationkey""",
    "billing": """
        SELECT o_custkey::VARCHAR AS identificador, ts0 AS datahorainternacao,
               CASE WHEN o_orderkey % 37 = 0 THEN 'SEPSE' ELSE 'CONSULTA' END AS procedimentosolicitado,
               CASE WHEN o_orderkey % 41 = 0 THEN 'REABILITACAO' END AS procprincipalsolicitado,
               NULL::VARCHAR AS procprincipalautorizado, NULL::VARCHAR AS procedimentosolicitadoeletiva
        FROM orders_at
        WHERE o_orderstatus <> 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "collapsed": f"""
        SELECT identificador, datahorainternacao, max(datahoraalta) AS datahoraalta,
               max(datasolicitacao) AS last_update, {", ".join(f"min({a}) AS {a}" for a in _ATTRS)}
        FROM visits WHERE datahorainternacao <> '{V.ADMISSION_SENTINEL}' GROUP BY ALL""",
    "parsed": f"SELECT *, try_strptime(datahorainternacao, {_FMT}) AS parsed_admission_ts FROM collapsed",
    "episodes": f"""
        SELECT * EXCLUDE (parsed_admission_ts),
               parsed_admission_ts + CASE year(parsed_admission_ts)
                   {" ".join(f"WHEN {y} THEN INTERVAL {n} YEAR" for y, n in V.YEAR_SHIFTS)}
                   ELSE INTERVAL 0 YEAR END AS admission_ts,
               CASE WHEN trim(datahoraalta) NOT IN ('', '{V.DISCHARGE_SENTINEL}')
                    THEN try_strptime(trim(datahoraalta), {_FMT}) END AS discharge_ts
        FROM parsed""",
    "followed": """
        SELECT e.*, n.admission_ts AS next_admission_ts, n.executante AS next_executante,
               n.municipioexecutante AS next_municipioexecutante, n.carater AS next_carater,
               n.codigocid AS next_codigocid,
               (n.admission_ts::DATE - e.discharge_ts::DATE) AS days_until_next_admission
        FROM episodes e
        ASOF LEFT JOIN (FROM episodes WHERE admission_ts IS NOT NULL) n
          ON e.identificador = n.identificador AND e.discharge_ts < n.admission_ts""",
    "gated": f"""
        SELECT *, CASE WHEN discharge_ts IS NULL OR coalesce(motivoalta, '') IN {_in(V.INELIGIBLE_REASONS)}
                       THEN 0 ELSE 1 END AS eligible_for_readmission_model
        FROM followed""",
    "raw_text": """
        SELECT e.identificador, e.admission_ts,
               string_agg(DISTINCT nullif(trim(v.procedimentosolicitado), ''), ' | '
                          ORDER BY nullif(trim(v.procedimentosolicitado), '')) AS procedure_text
        FROM visits v JOIN episodes e USING (identificador, datahorainternacao) GROUP BY ALL""",
    "billing_lines": """
        SELECT identificador, datahorainternacao AS admission_ts,
               nullif(trim(concat_ws(' | ', procedimentosolicitado, procprincipalsolicitado,
                                     procprincipalautorizado, procedimentosolicitadoeletiva)), '') AS line
        FROM billing""",
    "billing_text": """
        SELECT identificador, admission_ts, string_agg(DISTINCT line, ' | ' ORDER BY line) AS procedure_text
        FROM billing_lines GROUP BY ALL""",
    "candidates": f"""
        SELECT g.identificador, g.datahorainternacao, g.admission_ts,
               {_CHARACTER} AS admission_character,
               upper(translate(coalesce(next_codigocid, ''), '.-', '')) AS cid,
               upper(concat_ws(' | ', r.procedure_text, b.procedure_text)) AS procedures
        FROM gated g
        LEFT JOIN raw_text r ON g.identificador = r.identificador AND g.next_admission_ts = r.admission_ts
        LEFT JOIN billing_text b ON g.identificador = b.identificador AND g.next_admission_ts = b.admission_ts
        WHERE eligible_for_readmission_model = 1 AND days_until_next_admission BETWEEN 2 AND 30""",
    "signals": f"""
        SELECT *,
               (regexp_matches(cid, '{V.ACUTE_ICD_PATTERN}') OR coalesce(cid[1] = 'O' AND (
                   {" OR ".join(f"TRY_CAST(cid[2:3] AS INT) BETWEEN {a} AND {b}" for a, b in V.ACUTE_OBSTETRIC_RANGES)}
               ), false))::INT AS acute_cid_signal,
               regexp_matches(procedures, '{"|".join(V.ACUTE_PROCEDURES)}')::INT AS acute_procedure_signal,
               (cid[1:3] IN {_in(V.DELIVERY_ICD_PREFIXES)}
                OR regexp_matches(procedures, '{"|".join(V.ROUTINE_PROCEDURES)}')
                OR (contains(procedures, '{V.TRANSPLANT}') AND NOT {_like_any("procedures", V.POST_TRANSPLANT)})
               ) AS planned_care
        FROM candidates""",
    "classified": f"""
        SELECT identificador, datahorainternacao, admission_ts,
               CASE WHEN contains(admission_character, '{V.TRANSFER_FRAGMENT}') THEN 0
                    WHEN greatest(acute_cid_signal, acute_procedure_signal) = 1 THEN 1
                    WHEN {_like_any("admission_character", V.URGENT_FRAGMENTS)} AND NOT planned_care THEN 1
                    ELSE 0 END AS unplanned_readmitted_30d
        FROM signals""",
    "target": """
        SELECT g.* EXCLUDE (next_carater, next_codigocid),
               CASE eligible_for_readmission_model WHEN 1 THEN coalesce(c.unplanned_readmitted_30d, 0) END::INT
                   AS unplanned_readmitted_30d,
               coalesce(days_until_next_admission BETWEEN 0 AND 30, false)::INT AS readmitted_30d_raw,
               coalesce(days_until_next_admission BETWEEN 2 AND 30 AND eligible_for_readmission_model = 1, false)::INT
                   AS readmitted_30d_clean
        FROM gated g LEFT JOIN classified c
          ON g.identificador = c.identificador AND g.admission_ts = c.admission_ts""",
    "history": f"""
        SELECT *, {_STAY} AS length_of_stay_days,
               row_number() OVER runs - 1 AS previous_hospitalizations,
               lag(discharge_ts) OVER runs AS previous_discharge_ts,
               coalesce(sum(coalesce(unplanned_readmitted_30d, 0)) OVER (
                   PARTITION BY identificador ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
               ), 0)::BIGINT AS previous_unplanned_readmissions,
               {", ".join(
                   f"count(*) OVER (PARTITION BY identificador ORDER BY admission_ts RANGE BETWEEN INTERVAL {d} DAY "
                   f"PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS admissions_last_{d}d" for d in (30, 90, 365)
               )}
        FROM target WINDOW runs AS (PARTITION BY identificador ORDER BY {_ORDER})""",
    "features": f"""
        SELECT identificador, {_ATTR_LIST}, admission_ts, discharge_ts, length_of_stay_days,
               previous_hospitalizations, previous_unplanned_readmissions,
               admissions_last_30d, admissions_last_90d, admissions_last_365d,
               (admission_ts::DATE - previous_discharge_ts::DATE) AS days_since_previous_hospitalization,
               date_trunc('month', admission_ts)::TIMESTAMP AS admission_month,
               year(admission_ts) AS admission_year, quarter(admission_ts) AS admission_quarter,
               dayofweek(admission_ts) AS admission_weekday,
               {_spans("length_of_stay_days", V.STAY_BUCKETS, V.STAY_BUCKET_OPEN)} AS los_bucket,
               unplanned_readmitted_30d
        FROM history WHERE eligible_for_readmission_model = 1""",
    "pairs": f"""
        SELECT identificador, datahorainternacao, admission_ts, discharge_ts, executante, municipioexecutante,
               especialidade, tipoleito, carater, codigocid, motivoalta,
               lead(admission_ts) OVER runs AS next_admission_ts, lead(discharge_ts) OVER runs AS next_discharge_ts,
               {", ".join(f"lead({c}) OVER runs AS next_{c}" for c in
                          ("executante", "municipioexecutante", "especialidade", "tipoleito", "codigocid", "motivoalta"))}
        FROM target WINDOW runs AS (PARTITION BY identificador ORDER BY {_ORDER})""",
    "overlapping": f"""
        SELECT * EXCLUDE (datahorainternacao, carater),
               (discharge_ts::DATE - next_admission_ts::DATE) AS overlap_days,
               date_diff('hour', next_admission_ts, discharge_ts) AS overlap_hours,
               coalesce(executante = next_executante, false)::INT AS same_hospital,
               coalesce(especialidade = next_especialidade, false)::INT AS same_specialty,
               coalesce(motivoalta = '{V.TRANSFER}', false)::INT AS transfer_discharge
        FROM pairs WHERE next_admission_ts < discharge_ts""",
    "enriched": """
        SELECT t.identificador, t.admission_ts AS index_admission_ts, t.next_admission_ts, t.readmitted_30d_clean,
               t.discharge_ts AS index_discharge_ts, t.days_until_next_admission, t.eligible_for_readmission_model,
               t.carater AS index_carater, t.especialidade AS index_especialidade, t.codigocid AS index_codigocid,
               t.motivoalta AS index_motivoalta, t.tipoleito AS index_tipoleito,
               n.admission_ts AS matched_next_admission_ts, n.carater AS next_carater,
               n.especialidade AS next_especialidade, n.codigocid AS next_codigocid, n.motivoalta AS next_motivoalta,
               n.tipoleito AS next_tipoleito, n.executante AS next_executante,
               n.municipioexecutante AS next_municipioexecutante
        FROM target t LEFT JOIN episodes n
          ON n.identificador = t.identificador AND n.admission_ts = t.next_admission_ts
        WHERE t.readmitted_30d_clean = 1""",
    "stays": f"SELECT *, {_STAY} AS length_of_stay_days FROM target",
    "subjects": """
        SELECT 'appointments' AS t, c_custkey::VARCHAR AS k FROM customer
        UNION ALL SELECT 'regulated_exams', o_custkey::VARCHAR FROM orders
        UNION ALL SELECT 'non_regulated_exams', user_id::VARCHAR FROM events
        UNION ALL SELECT 'requests', doc_id::VARCHAR FROM labels
        UNION ALL SELECT 'hospitalizations', identificador FROM visits
        UNION ALL SELECT 'billing', identificador FROM billing""",
}

# A relation is referred to right after FROM or JOIN, perhaps inside a bracket.
_USES = re.compile(r"\b(?:FROM|JOIN)\s+\(?\s*(?:FROM\s+)?([a-z_]+)")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _USES.findall(sql):
        if name in _RELATIONS and name not in seen:
            _needed(_RELATIONS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _with(sql: str) -> str:
    parts = [f"{name} AS ({_RELATIONS[name].strip()})" for name in _needed(sql, [])]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()


_PCT = "round({0} * 100.0 / nullif({1}, 0), 2)"


def _pct(part: str, whole: str) -> str:
    return _PCT.format(part, whole)


def _share(source: str, key: str, alias: str, count: str, where: str = "true") -> str:
    return (
        f"SELECT {key} AS {alias}, count(*) AS {count}, "
        f"{_pct('count(*)', f'(SELECT count(*) FROM {source} WHERE {where})')} AS percentage "
        f"FROM {source} WHERE {where} GROUP BY 1"
    )


def _inner_share(source: str, group: str, member: str, names: tuple[str, str], count: str, share: str) -> str:
    return (
        f"SELECT {names[0]}, {names[1]}, {count}, "
        f"round({count} * 100.0 / sum({count}) OVER (PARTITION BY {names[0]}), 2) AS {share} "
        f"FROM (SELECT {group} AS {names[0]}, {member} AS {names[1]}, count(*) AS {count} "
        f"FROM {source} GROUP BY 1, 2)"
    )


def _rates(key: str, where: str = "true", least: int = 0) -> str:
    return (
        f"SELECT {key}, count(*) AS episodes, sum(unplanned_readmitted_30d)::BIGINT AS readmissions, "
        f"sum(unplanned_readmitted_30d) * 100.0 / count(*) AS rate FROM features WHERE {where} "
        f"GROUP BY 1 HAVING count(*) >= {least}"
    )


def _stated(column: str, text: str = V.NOT_STATED) -> str:
    return f"coalesce({column}, '{text}')"


def _long_stays(group: str) -> str:
    return (
        f"SELECT {group}, count(*) AS total_episodes, "
        + ", ".join(f"count_if(length_of_stay_days > {d})::BIGINT AS los_over_{d}_days" for d in (90, 180, 365))
        + ", round(avg(length_of_stay_days), 2) AS average_los, max(length_of_stay_days) AS maximum_los "
        f"FROM stays WHERE length_of_stay_days IS NOT NULL GROUP BY 1 HAVING los_over_90_days > 0"
    )


def _zero_by(group: str) -> str:
    return (
        f"SELECT {group}, count(*) AS zero_day_episodes FROM stays WHERE length_of_stay_days = 0 "
        f"GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 30"
    )


def _gaps(where: str, count: str = "episodes") -> str:
    return f"SELECT days_until_next_admission, count(*) AS {count} FROM target WHERE {where} GROUP BY 1"


def _top(source: str, group: str, k: int = 20) -> str:
    return f"SELECT {group}, count(*) AS episodes FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT {k}"


_KEYS = "identificador, datahorainternacao"
_TRACE = (
    "identificador, admission_ts, discharge_ts, next_admission_ts, days_until_next_admission, motivoalta, "
    "executante, especialidade, codigocid, readmitted_30d_clean"
)
_CLOSED = f"motivoalta = '{V.ADMINISTRATIVE_CLOSURE}'"
_NEXT = (
    f"SELECT {_KEYS}, admission_ts, discharge_ts, next_admission_ts, next_executante, next_municipioexecutante, "
    "next_carater, next_codigocid FROM followed"
)
_TOP5 = f"SELECT {_TRACE} FROM target JOIN (SELECT identificador FROM target GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) USING (identificador)"
_GROUP_CASE = "CASE " + " ".join(
    f"WHEN {_like_any(_stated('upper(next_especialidade)', ''), fragments)} THEN '{label}'"
    for label, fragments in V.SPECIALTY_GROUPS
) + f" ELSE '{V.OTHER_SPECIALTIES}' END"
_SPECIALTIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_CELLS = f"""
    SELECT executante, especialidade, count(*) AS episodes, sum(unplanned_readmitted_30d)::BIGINT AS readmissions,
           sum(unplanned_readmitted_30d) * 100.0 / count(*) AS rate
    FROM features
    WHERE executante IN (SELECT executante FROM features WHERE executante IS NOT NULL
                         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
      AND especialidade IN (SELECT especialidade FROM features WHERE especialidade IS NOT NULL
                            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    GROUP BY 1, 2 HAVING count(*) >= {HEATMAP_MIN_EPISODES}"""
_FIELDS = {
    "sex": "sexo", "request_city": "municipiosolicitante", "hospital_city": "municipioexecutante",
    "hospital": "executante", "specialty": "especialidade", "bed": "tipoleito", "admission_type": "carater",
    "discharge_reason": "motivoalta", "years": "admission_year", "quarters": "admission_quarter",
    "weekdays": "admission_weekday",
}
_VISIT_COLUMNS = (
    ("identificador", "string"), ("datasolicitacao", "date"), ("datahorasolicitacao", "timestamp_ntz"),
    ("datahorainternacao", "string"), ("datahoraalta", "string"), ("situacao", "string"),
    *[(a, "string") for a in _ATTRS], ("procedimentosolicitado", "string"),
)
_BILLING_COLUMNS = (
    ("identificador", "string"), ("datahorainternacao", "timestamp_ntz"), ("procedimentosolicitado", "string"),
    ("procprincipalsolicitado", "string"), ("procprincipalautorizado", "string"),
    ("procedimentosolicitadoeletiva", "string"),
)
# Columns of the given tables in the role of extracts: the subject first.
_EXTRACT_COLUMNS = {
    "appointments": ("customer", (("c_custkey", "string"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))),
    "regulated_exams": (
        "orders",
        (("o_custkey", "string"), ("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
         ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")),
    ),
    "non_regulated_exams": (
        "events",
        (("user_id", "string"), ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("event_type", "string"), ("value", "double"), ("props", "string")),
    ),
    "requests": ("labels", (("doc_id", "string"), ("quality", "int"), ("toxic", "int"))),
    "hospitalizations": ("visits", _VISIT_COLUMNS),
    "billing": ("billing", _BILLING_COLUMNS),
}


def _extract_columns():
    """(table, source, SQL column, name in the extract, type) of every column of every extract."""
    for table, (source, columns) in _EXTRACT_COLUMNS.items():
        for i, (column, kind) in enumerate(columns):
            yield table, source, column, column if i else "identificador", kind


def _text_of(column: str, kind: str) -> str:
    if kind == "double":
        return f"{column}::DECIMAL(38,6)::VARCHAR"
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if kind.startswith("timestamp") else f"{column}::VARCHAR"


def _catalog_sql() -> str:
    """Statistics of every column of every extract."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{name}' AS column_name, '{kind}' AS column_type, count(*) AS rows, "
        f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM {source}"
        for t, source, c, name, kind in _extract_columns()
    )


def _text_catalog_sql() -> str:
    """The same without types, as a text file holds the columns: an empty text is a NULL."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{name}' AS column_name, count(*) AS rows, count(*) - count(v) AS nulls, "
        f"count(DISTINCT v) AS distinct_values FROM (SELECT nullif({_text_of(c, kind)}, '') AS v FROM {source})"
        for t, source, c, name, kind in _extract_columns()
    )


def _sample_sql(n: int) -> str:
    parts = []
    for table, (source, columns) in _EXTRACT_COLUMNS.items():
        order = ", ".join(f"{c + '::VARCHAR' if i == 0 else c} NULLS FIRST" for i, (c, _) in enumerate(columns))
        few = f"(SELECT *, row_number() OVER (ORDER BY {order})::INTEGER AS row FROM {source} ORDER BY {order} LIMIT {n})"
        parts += [
            f"SELECT '{table}' AS table_name, row, '{c if i else 'identificador'}' AS column_name, {_text_of(c, kind)} AS value FROM {few}"
            for i, (c, kind) in enumerate(columns)
        ]
    return " UNION ALL ".join(parts)


# Groupings of the rate cube and its keys in order.
_GROUPINGS = {
    "all": (), "specialty": ("especialidade",), "hospital": ("executante",), "reason": ("motivoalta",),
    "pair": ("executante", "especialidade"), "icd": ("codigocid",), "month": ("admission_month",),
    "quarter": ("admission_year", "admission_quarter"), "history": ("previous_hospitalizations",),
}
_CUBE_KEYS = (
    "especialidade", "executante", "motivoalta", "codigocid", "admission_month", "admission_year", "admission_quarter",
    "previous_hospitalizations",
)


def _cube_sql() -> str:
    parts = []
    for name, keys in _GROUPINGS.items():
        texts = {k: f"strftime({k}, '%Y-%m-%d')" if k == "admission_month" else f"{k}::VARCHAR" for k in keys}
        text = " || '|' || ".join(f"coalesce({texts[k]}, '')" if k in keys else "''" for k in _CUBE_KEYS)
        means = ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in ("length_of_stay_days", "previous_hospitalizations", "admissions_last_365d"))
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        parts.append(
            f"SELECT '{name}' AS grouping, {text} AS keys, count(*) AS episodes, sum(unplanned_readmitted_30d)::BIGINT AS readmissions, "
            f"{means} FROM features {group}"
        )
    return " UNION ALL ".join(parts)


_SQL: dict[str, str] = {
    # sources and catalog
    "ingest_csv": f"""SELECT identificador, datasolicitacao::VARCHAR AS datasolicitacao,
        datahorasolicitacao::VARCHAR AS datahorasolicitacao,
        CASE situacao WHEN 'F' THEN 'say "hi", now' || chr(10) || 'line' WHEN 'O' THEN 'a\\' END AS situacao,
        {", ".join(f"nullif({c}, '') AS {c}" for c in ("datahorainternacao", "datahoraalta", *_ATTRS, "procedimentosolicitado"))}
        FROM visits""",
    "parquet_roundtrip": "SELECT t AS table_name, count(*) AS rows, 0::BIGINT AS differing_rows FROM subjects GROUP BY 1",
    "row_counts": """SELECT t AS table_name, count(*) AS rows FROM subjects GROUP BY 1
        UNION ALL SELECT 'hospitalization_episodes_clean', count(*) FROM episodes
        UNION ALL SELECT 'hospitalization_target', count(*) FROM target
        UNION ALL SELECT 'ml_features', count(*) FROM features""",
    "describe_schema": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, d.column_name, d.column_type, c.non_null FROM (DESCRIBE {t}) d JOIN
        (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE non_null) c USING (column_name)"""
        for t in DESCRIBED
    ),
    "ingest_all": _text_catalog_sql(),
    "sample_rows": _sample_sql(5),
    "data_catalog": _catalog_sql(),
    "data_catalog_sketch": f"SELECT table_name, column_name, rows, nulls, true AS estimate_holds FROM ({_catalog_sql()})",
    # episodes and target
    "collapse_episodes": "SELECT * FROM collapsed",
    "parse_admission": f"SELECT {_KEYS}, parsed_admission_ts FROM parsed",
    "correct_admission": f"SELECT {_KEYS}, admission_ts FROM episodes",
    "parse_discharge": f"SELECT {_KEYS}, datahoraalta, discharge_ts FROM episodes",
    "next_episode": _NEXT,
    "next_episode_split": _NEXT,
    "days_until_next": f"SELECT {_KEYS}, days_until_next_admission FROM followed",
    "eligibility": f"SELECT {_KEYS}, eligible_for_readmission_model FROM gated",
    "raw_procedures": "SELECT * FROM raw_text",
    "billing_procedures": "SELECT * FROM billing_text",
    "candidates": f"SELECT {_KEYS}, admission_ts, admission_character, cid FROM candidates",
    "acute_icd_signal": f"SELECT {_KEYS}, acute_cid_signal FROM signals",
    "acute_procedure_signal": f"SELECT {_KEYS}, acute_procedure_signal FROM signals",
    "classify_unplanned": f"SELECT {_KEYS}, unplanned_readmitted_30d FROM classified",
    "build_target": "SELECT * FROM target",
    "build_target_split": "SELECT * FROM target",
    "target_invariants": """SELECT (SELECT count(*) FROM episodes) AS clean_episodes, count(*) AS target_episodes,
        count_if(eligible_for_readmission_model = 0 AND unplanned_readmitted_30d IS NOT NULL)::BIGINT AS ineligible_with_label,
        count_if(eligible_for_readmission_model = 1 AND unplanned_readmitted_30d IS NULL)::BIGINT AS eligible_without_label,
        count_if(unplanned_readmitted_30d = 1 AND (days_until_next_admission < 2 OR days_until_next_admission > 30))::BIGINT
            AS positives_outside_window FROM target""",
    "target_summary": f"""SELECT count(*) AS total_episodes,
        count_if(eligible_for_readmission_model = 1)::BIGINT AS eligible_episodes,
        count_if(unplanned_readmitted_30d = 1)::BIGINT AS unplanned_readmissions,
        {_pct("count_if(unplanned_readmitted_30d = 1)", "count_if(eligible_for_readmission_model = 1)")}
            AS unplanned_readmission_rate FROM target""",
    "build_features": "SELECT * FROM features",
    "build_features_split": "SELECT * FROM features",
    "feature_invariants": """SELECT (SELECT count(*) FROM target WHERE eligible_for_readmission_model = 1) AS eligible_episodes,
        count(*) AS feature_rows FROM features""",
    "feature_summary": """SELECT count(*) AS total_records, sum(unplanned_readmitted_30d)::BIGINT AS unplanned_readmissions,
        round(avg(unplanned_readmitted_30d) * 100, 2) AS unplanned_readmission_rate,
        round(avg(length_of_stay_days), 2) AS avg_length_of_stay_days FROM features""",
    # windows
    "previous_hospitalizations": f"SELECT {_KEYS}, previous_hospitalizations FROM history",
    "days_since_previous": f"""SELECT {_KEYS}, (admission_ts::DATE - previous_discharge_ts::DATE)
        AS days_since_previous_hospitalization FROM history""",
    "previous_unplanned": f"SELECT {_KEYS}, previous_unplanned_readmissions FROM history",
    "admissions_last_30d": f"SELECT {_KEYS}, admissions_last_30d FROM history",
    "admissions_last_90d": f"SELECT {_KEYS}, admissions_last_90d FROM history",
    "admissions_last_365d": f"SELECT {_KEYS}, admissions_last_365d FROM history",
    "lead_next": "SELECT * FROM pairs",
    "lead_next_split": "SELECT * FROM pairs",
    "share_of_total": _share("target", "especialidade", "especialidade", "episodes"),
    "share_within_group": _inner_share(
        "target", "especialidade", "motivoalta", ("especialidade", "motivoalta"), "episodes", "percentage"
    ),
    # joins, grains, lookups, samples
    "enrich_next": "SELECT * FROM enriched",
    "cross_denominator": f"""SELECT d.n AS eligible_episodes, d.r AS all_readmissions,
        count_if({_PLANNING} = '{V.UNPLANNED}')::BIGINT AS potentially_unplanned_readmissions,
        {_pct(f"count_if({_PLANNING} = '{V.UNPLANNED}')", "d.n")} AS conservative_unplanned_rate
        FROM enriched, (SELECT count(*) AS n, sum(readmitted_30d_clean)::BIGINT AS r
                        FROM target WHERE eligible_for_readmission_model = 1) d
        GROUP BY d.n, d.r""",
    "zero_day_hospitals": """SELECT executante, count(*) AS episodes FROM visits
        WHERE identificador IN (SELECT identificador FROM target WHERE days_until_next_admission = 0)
        GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 20""",
    "top_patients_history": _TOP5,
    "key_overlap_pairs": """SELECT p.a AS table_a, p.b AS table_b, count(DISTINCT x.k) AS shared_keys
        FROM (SELECT a.t AS a, b.t AS b FROM (VALUES (1, 'appointments'), (2, 'regulated_exams'),
                (3, 'non_regulated_exams'), (4, 'requests'), (5, 'hospitalizations'), (6, 'billing')) a(i, t)
              JOIN (VALUES (1, 'appointments'), (2, 'regulated_exams'), (3, 'non_regulated_exams'),
                (4, 'requests'), (5, 'hospitalizations'), (6, 'billing')) b(i, t) ON a.i < b.i) p
        LEFT JOIN (SELECT DISTINCT x.k, x.t AS a, y.t AS b FROM (SELECT DISTINCT t, k FROM subjects) x
                   JOIN (SELECT DISTINCT t, k FROM subjects) y ON x.k = y.k) x ON x.a = p.a AND x.b = p.b
        GROUP BY 1, 2""",
    "distinct_grain_check": f"""SELECT count(*) AS total_rows,
        count(DISTINCT identificador || '|' || datahorainternacao) AS by_patient_admission,
        count(DISTINCT identificador || '|' || datasolicitacao) AS by_patient_request_date,
        count(DISTINCT identificador || '|' || datasolicitacao || '|' || datahorainternacao) AS by_patient_request_admission
        FROM visits WHERE datahorainternacao <> '{V.ADMISSION_SENTINEL}'""",
    "prefix_lookup": f"SELECT {_KEYS}, admission_ts, discharge_ts FROM target WHERE identificador LIKE '12%'",
    "random_sample": f"""SELECT {_KEYS}, admission_ts FROM target
        ORDER BY md5(concat_ws('|', '7', identificador, datahorainternacao)), 1, 2 LIMIT 50""",
    # derived columns
    "length_of_stay": f"SELECT {_KEYS}, length_of_stay_days FROM stays",
    "calendar_features": f"""SELECT {_KEYS}, date_trunc('month', admission_ts)::TIMESTAMP AS admission_month,
        year(admission_ts) AS admission_year, quarter(admission_ts) AS admission_quarter,
        dayofweek(admission_ts) AS admission_weekday FROM target""",
    "los_bucket": f"""SELECT {_KEYS}, {_spans("length_of_stay_days", V.STAY_BUCKETS, V.STAY_BUCKET_OPEN)} AS los_bucket
        FROM stays""",
    # dates
    "aud_date_quality": f"""SELECT count(*) AS total_episodes, count(*) - count(admission_ts) AS missing_admission,
        count(*) - count(discharge_ts) AS missing_discharge,
        count_if(discharge_ts < admission_ts)::BIGINT AS negative_los,
        count_if(length_of_stay_days = 0)::BIGINT AS zero_day_los,
        {", ".join(f"count_if(length_of_stay_days > {d})::BIGINT AS los_over_{d}_days" for d in (30, 90, 180, 365, 1000))},
        min(length_of_stay_days) AS minimum_los, max(length_of_stay_days) AS maximum_los,
        round(avg(length_of_stay_days), 2) AS average_los FROM stays""",
    "aud_year_ranges": """SELECT min(admission_ts) AS earliest_admission, max(admission_ts) AS latest_admission,
        min(discharge_ts) AS earliest_discharge, max(discharge_ts) AS latest_discharge,
        year(min(admission_ts)) AS minimum_admission_year, year(max(admission_ts)) AS maximum_admission_year,
        year(min(discharge_ts)) AS minimum_discharge_year, year(max(discharge_ts)) AS maximum_discharge_year
        FROM target""",
    "aud_out_of_range": """SELECT identificador, admission_ts, discharge_ts, length_of_stay_days, executante,
        especialidade, tipoleito, codigocid, motivoalta FROM stays
        WHERE year(admission_ts) NOT BETWEEN 2023 AND 2026 OR year(discharge_ts) NOT BETWEEN 2023 AND 2026""",
    "aud_longest_stays": """SELECT identificador, admission_ts, discharge_ts, length_of_stay_days, executante,
        municipioexecutante, especialidade, tipoleito, carater, codigocid, motivoalta FROM stays
        WHERE length_of_stay_days IS NOT NULL ORDER BY length_of_stay_days DESC, identificador, admission_ts LIMIT 100""",
    "aud_long_stays_by_hospital": _long_stays("executante"),
    "aud_long_stays_by_specialty": _long_stays("especialidade"),
    "aud_los_distribution": f"""SELECT CASE WHEN discharge_ts IS NULL THEN '{V.AUDIT_STAY_MISSING}' ELSE
        {_spans("length_of_stay_days", V.AUDIT_STAY_BUCKETS, V.AUDIT_STAY_OPEN)} END AS los_bucket,
        count(*) AS episodes FROM stays GROUP BY 1""",
    "aud_zero_day_summary": f"""SELECT count(*) AS zero_day_episodes, count(DISTINCT identificador) AS affected_patients,
        {_pct("count(*)", "(SELECT count(*) FROM target)")} AS percentage_of_episodes
        FROM stays WHERE length_of_stay_days = 0""",
    "aud_zero_day_by_hospital": _zero_by("executante"),
    "aud_zero_day_by_specialty": _zero_by("especialidade"),
    "aud_year_errors": """SELECT identificador, admission_ts, discharge_ts, year(admission_ts) AS admission_year,
        year(discharge_ts) AS discharge_year, length_of_stay_days, executante, especialidade, codigocid, motivoalta
        FROM stays WHERE year(discharge_ts) - year(admission_ts) NOT BETWEEN -1 AND 1""",
    "aud_extreme_los": """SELECT identificador, admission_ts, discharge_ts, next_admission_ts, length_of_stay_days,
        days_until_next_admission, executante, especialidade, codigocid, motivoalta, readmitted_30d_clean
        FROM stays WHERE length_of_stay_days > 365""",
    # overlaps
    "aud_overlaps": "SELECT * FROM overlapping",
    "aud_overlap_summary": """SELECT count(*) AS overlapping_episodes, count(DISTINCT identificador) AS affected_patients,
        sum(same_hospital)::BIGINT AS same_hospital, count_if(executante <> next_executante)::BIGINT AS different_hospital,
        sum(same_specialty)::BIGINT AS same_specialty, sum(transfer_discharge)::BIGINT AS transfer_discharge
        FROM overlapping""",
    "aud_overlap_buckets": f"""SELECT CASE WHEN overlap_hours <= 24
        THEN {_spans("overlap_hours", V.OVERLAP_HOUR_BUCKETS, "")}
        ELSE {_spans("overlap_days", V.OVERLAP_DAY_BUCKETS, V.OVERLAP_OPEN)} END AS overlap_bucket,
        count(*) AS episodes FROM overlapping GROUP BY 1""",
    "aud_overlap_count": "SELECT count(*) AS overlapping_episodes FROM overlapping",
    # episodes
    "aud_episode_counts": """SELECT count(*) AS total_episodes, count(DISTINCT identificador) AS patients,
        round(count(*) / count(DISTINCT identificador), 2) AS avg_episodes_per_patient FROM target""",
    "aud_top_patients": _top("target", "identificador", 30),
    "aud_duplicates": """SELECT identificador, admission_ts, count(*) AS records FROM target GROUP BY 1, 2
        HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 30""",
    "aud_los_quality": """SELECT count(*) AS total, count_if(discharge_ts IS NULL)::BIGINT AS missing_discharge,
        count_if(length_of_stay_days < 0)::BIGINT AS negative_los, count_if(length_of_stay_days = 0)::BIGINT AS zero_day_los,
        count_if(length_of_stay_days > 365)::BIGINT AS los_over_365, min(length_of_stay_days) AS min_los,
        max(length_of_stay_days) AS max_los, round(avg(length_of_stay_days), 2) AS avg_los FROM stays""",
    "aud_short_gaps": _gaps("days_until_next_admission BETWEEN 0 AND 7"),
    "aud_death_then_admission": f"""SELECT count(next_admission_ts) AS death_followed_by_admission FROM target
        WHERE motivoalta = '{V.DEATH}'""",
    "aud_transfer_gaps": _gaps(f"motivoalta = '{V.TRANSFER}' AND days_until_next_admission BETWEEN 0 AND 30"),
    "aud_target_distribution": _share("target", "readmitted_30d_clean", "readmitted_30d_clean", "episodes"),
    "aud_rate_by_reason": """SELECT motivoalta, count(*) AS episodes, sum(readmitted_30d_clean)::BIGINT AS readmissions,
        round(avg(readmitted_30d_clean) * 100, 2) AS readmission_rate FROM target GROUP BY 1""",
    "aud_sample_positives": f"""SELECT {_TRACE} FROM target WHERE readmitted_30d_clean = 1
        ORDER BY md5(concat_ws('|', '0', identificador, admission_ts::VARCHAR)), 1, 2 LIMIT 20""",
    "aud_top_patient_episodes": _TOP5,
    "aud_target_summary": f"""SELECT count(*) AS total_episodes,
        count_if(eligible_for_readmission_model = 1)::BIGINT AS eligible_episodes,
        count_if(eligible_for_readmission_model = 0)::BIGINT AS ineligible_episodes,
        count_if(unplanned_readmitted_30d = 1)::BIGINT AS unplanned_readmissions,
        count_if(unplanned_readmitted_30d = 0)::BIGINT AS episodes_without_unplanned_readmission,
        {_pct("count_if(unplanned_readmitted_30d = 1)", "count_if(eligible_for_readmission_model = 1)")}
            AS unplanned_readmission_rate FROM target""",
    "aud_general_vs_unplanned": f"""SELECT sum(readmitted_30d_clean)::BIGINT AS general_readmissions_2_30d,
        count_if(unplanned_readmitted_30d = 1)::BIGINT AS unplanned_readmissions_2_30d,
        count_if(readmitted_30d_clean = 1 AND unplanned_readmitted_30d = 0)::BIGINT AS readmissions_not_classified_as_unplanned,
        {_pct("count_if(readmitted_30d_clean = 1 AND unplanned_readmitted_30d = 0)", "sum(readmitted_30d_clean)")}
            AS excluded_from_general_readmissions_percentage FROM target""",
    "aud_consistency": """SELECT (SELECT count(*) FROM episodes) AS clean_episodes, count(*) AS target_episodes,
        count_if(eligible_for_readmission_model = 0 AND unplanned_readmitted_30d IS NOT NULL)::BIGINT
            AS ineligible_with_non_null_target,
        count_if(eligible_for_readmission_model = 1 AND unplanned_readmitted_30d IS NULL)::BIGINT AS eligible_with_null_target,
        count_if(unplanned_readmitted_30d = 1 AND (days_until_next_admission < 2 OR days_until_next_admission > 30))::BIGINT
            AS positives_outside_window,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT identificador, admission_ts FROM target)) AS duplicate_episodes
        FROM target""",
    "aud_ineligible_reasons": f"""SELECT CASE WHEN motivoalta IN {_in(V.INELIGIBLE_REASONS)} THEN motivoalta
        WHEN discharge_ts IS NULL THEN '{V.MISSING_DISCHARGE_REASON}' ELSE '{V.OTHER_REASON}' END AS reason,
        count(*) AS episodes FROM target WHERE eligible_for_readmission_model = 0 GROUP BY 1""",
    "aud_interval_distribution": _gaps("unplanned_readmitted_30d = 1", "unplanned_readmissions"),
    "aud_raw_vs_clean": f"""SELECT sum(readmitted_30d_raw)::BIGINT AS raw_readmissions,
        sum(readmitted_30d_clean)::BIGINT AS clean_readmissions, count(*) AS total_episodes,
        {_pct("sum(readmitted_30d_raw)", "count(*)")} AS raw_rate,
        {_pct("sum(readmitted_30d_clean)", "count(*)")} AS clean_rate FROM target""",
    "aud_excluded_reasons": f"""SELECT motivoalta, count(*) AS episodes, sum(readmitted_30d_raw)::BIGINT AS raw_readmissions,
        sum(readmitted_30d_clean)::BIGINT AS clean_readmissions FROM target
        WHERE motivoalta IN {_in(V.REPORTED_REASONS)} GROUP BY 1""",
    "aud_days_histogram": _gaps("days_until_next_admission BETWEEN 0 AND 30"),
    "aud_zero_gap_by_reason": "SELECT motivoalta, count(*) AS episodes FROM target WHERE days_until_next_admission = 0 GROUP BY 1",
    # planning
    "aud_join_coverage": f"""SELECT count(*) AS total_readmissions, count(matched_next_admission_ts) AS matched_readmissions,
        count(*) - count(matched_next_admission_ts) AS unmatched_readmissions,
        {_pct("count(matched_next_admission_ts)", "count(*)")} AS match_percentage FROM enriched""",
    "aud_next_character": _share("enriched", _stated("next_carater"), "next_carater", "readmissions"),
    "aud_planning_proxy": _share("enriched", _PLANNING, "planning_classification", "readmissions"),
    "aud_specialty_by_character": _inner_share(
        "enriched", _stated("next_carater"), _stated("next_especialidade"),
        ("next_carater", "next_especialidade"), "readmissions", "percentage_within_character",
    ),
    "aud_routine_specialties": _inner_share(
        "enriched", _GROUP_CASE, _stated("next_carater"), ("specialty_group", "next_carater"),
        "readmissions", "percentage_within_group",
    ),
    "aud_elective_specialties": _share(
        "enriched", _stated("next_especialidade"), "next_especialidade", "elective_readmissions",
        _like_any(_CHARACTER, V.ELECTIVE_FRAGMENTS),
    ),
    "aud_urgent_specialties": _share(
        "enriched", _stated("next_especialidade"), "next_especialidade", "urgent_readmissions",
        _like_any(_CHARACTER, V.URGENT_FRAGMENTS),
    ),
    "aud_icd_by_character": f"""SELECT {_stated("next_carater")} AS next_carater, {_stated("next_codigocid")} AS next_codigocid,
        count(*) AS readmissions FROM enriched GROUP BY 1, 2""",
    "aud_rate_comparison": f"""SELECT d.n AS eligible_episodes, d.r AS all_readmissions,
        count_if({_PLANNING} = '{V.PLANNED}')::BIGINT AS potentially_planned_readmissions,
        count_if({_PLANNING} = '{V.UNPLANNED}')::BIGINT AS potentially_unplanned_readmissions,
        count_if({_PLANNING} = '{V.UNDETERMINED}')::BIGINT AS indeterminate_readmissions,
        {_pct("d.r", "d.n")} AS general_readmission_rate,
        {_pct(f"count_if({_PLANNING} = '{V.UNPLANNED}')", "d.n")} AS conservative_unplanned_rate
        FROM enriched, (SELECT count(*) AS n, sum(readmitted_30d_clean)::BIGINT AS r
                        FROM target WHERE eligible_for_readmission_model = 1) d
        GROUP BY d.n, d.r""",
    "aud_review_sample": f"""SELECT *, {_PLANNING} AS exploratory_classification FROM enriched
        ORDER BY md5(concat_ws('|', '0', identificador, index_admission_ts::VARCHAR)), 1, 2 LIMIT 300""",
    # closures and traces
    "aud_closure_status": f"SELECT motivoalta, situacao, count(*) AS episodes FROM visits WHERE {_CLOSED} GROUP BY 1, 2",
    "aud_closure_hospital": f"SELECT executante, count(*) AS episodes FROM visits WHERE {_CLOSED} GROUP BY 1",
    "aud_closure_dates": f"""SELECT min(datasolicitacao) AS min_request_date, max(datasolicitacao) AS max_request_date,
        count(*) AS episodes FROM visits WHERE {_CLOSED}""",
    "aud_closure_next": f"""SELECT count(*) AS total_closures,
        count_if(days_until_next_admission BETWEEN 0 AND 30)::BIGINT AS next_admission_0_30d,
        count_if(days_until_next_admission BETWEEN 2 AND 30)::BIGINT AS next_admission_2_30d
        FROM target WHERE {_CLOSED}""",
    "aud_closure_sample": f"""SELECT identificador, datasolicitacao, datahorasolicitacao, datahorainternacao, datahoraalta,
        situacao, executante, especialidade, tipoleito, carater, codigocid, motivoalta FROM visits WHERE {_CLOSED}
        ORDER BY datasolicitacao, identificador, datahorasolicitacao, datahorainternacao, datahoraalta, situacao,
                 executante, especialidade, tipoleito, carater, codigocid LIMIT 30""",
    "aud_patient_raw": """SELECT identificador, datasolicitacao, datahorasolicitacao, datahorainternacao, datahoraalta,
        situacao, executante, municipioexecutante, especialidade, tipoleito, carater, codigocid, motivoalta
        FROM visits WHERE starts_with(identificador, '101')""",
    "aud_patient_episodes": """SELECT identificador, datahorainternacao, datahoraalta, last_update, admission_ts,
        discharge_ts, length_of_stay_days, executante, especialidade, codigocid, motivoalta
        FROM stays WHERE starts_with(identificador, '101')""",
    "aud_top_hospitals": _top("features", "executante"),
    "aud_top_residence": _top("features", "municipioresidencia"),
    "aud_feature_ranges": """SELECT min(length_of_stay_days) AS min_length_of_stay,
        max(length_of_stay_days) AS max_length_of_stay, avg(length_of_stay_days) AS avg_length_of_stay FROM features""",
    "aud_history_histogram": """SELECT previous_hospitalizations, count(*) AS episodes FROM features
        GROUP BY 1 ORDER BY 1 LIMIT 20""",
    # marts
    "rate_cube": _cube_sql(),
    "clean_features": "SELECT * FROM features",
    "overall_rate": "SELECT coalesce(avg(unplanned_readmitted_30d) * 100, 0) AS overall_rate FROM features",
    "kpis": """SELECT count(*) AS total_episodes, sum(unplanned_readmitted_30d)::BIGINT AS unplanned_readmissions,
        sum(unplanned_readmitted_30d)::BIGINT AS readmissions,
        sum(unplanned_readmitted_30d) * 100.0 / count(*) AS rate, avg(length_of_stay_days) AS avg_los,
        avg(previous_hospitalizations) AS avg_previous_hospitalizations,
        avg(admissions_last_365d) AS avg_admissions_last365 FROM features""",
    "kpis_patients": """SELECT count(*) AS total_episodes, sum(unplanned_readmitted_30d)::BIGINT AS unplanned_readmissions,
        sum(unplanned_readmitted_30d) * 100.0 / count(*) AS rate,
        count(DISTINCT identificador) AS unique_patients,
        count(DISTINCT identificador) FILTER (unplanned_readmitted_30d = 1) AS readmitted_patients,
        avg(length_of_stay_days) AS avg_los, avg(previous_hospitalizations) AS avg_previous_hospitalizations,
        avg(previous_unplanned_readmissions) AS avg_previous_unplanned,
        avg(admissions_last_365d) AS avg_admissions_last365 FROM features""",
    "filter_options": " UNION ALL ".join(
        f"SELECT DISTINCT '{field}' AS field, {column}::VARCHAR AS value FROM features WHERE {column} IS NOT NULL"
        for field, column in _FIELDS.items()
    ),
    "filter_maxima": """SELECT greatest(1, max(coalesce(length_of_stay_days, 0))) AS max_stay,
        max(previous_hospitalizations) AS max_previous_hospitalizations,
        max(previous_unplanned_readmissions) AS max_previous_readmissions,
        max(admissions_last_365d) AS max_admissions_last_365d FROM features""",
    "apply_filters": """SELECT * FROM features WHERE sexo = 'F' AND especialidade IN ('ECONOMY', 'PROMO', 'STANDARD')
        AND admission_year IN (2020, 2022, 2024) AND admission_quarter IS NOT NULL AND admission_weekday IS NOT NULL
        AND coalesce(length_of_stay_days, 0) <= 10 AND admissions_last_365d <= 3""",
    "apply_filters_default": """SELECT * FROM features WHERE admission_year IS NOT NULL
        AND coalesce(length_of_stay_days, 0) <= least(60, (SELECT greatest(1, max(coalesce(length_of_stay_days, 0))) FROM features))""",
    "rate_table": _rates(f"coalesce(motivoalta, '{V.NOT_INFORMED}') AS motivoalta"),
    "specialty_rate": _rates(f"coalesce(especialidade, '{V.NOT_INFORMED}') AS especialidade", least=MIN_EPISODES)
    + " ORDER BY rate DESC, 1 LIMIT 20",
    "hospital_rate": _rates(f"coalesce(executante, '{V.NOT_INFORMED}') AS executante", least=MIN_EPISODES)
    + " ORDER BY rate DESC, 1 LIMIT 20",
    "monthly_trend": _rates("admission_month"),
    "quarterly_trend": """SELECT admission_year, admission_quarter, count(*) AS episodes,
        sum(unplanned_readmitted_30d)::BIGINT AS readmissions, sum(unplanned_readmitted_30d) * 100.0 / count(*) AS rate,
        admission_year || ' Q' || admission_quarter AS quarter
        FROM features WHERE admission_year IS NOT NULL GROUP BY 1, 2""",
    "los_distribution": f"""SELECT (length_of_stay_days // w * w)::BIGINT AS bin_start, w::BIGINT AS bin_width,
        CASE unplanned_readmitted_30d {" ".join(f"WHEN {v} THEN '{t}'" for v, t in V.OUTCOME_LABELS.items())} END AS status,
        count(*) AS episodes
        FROM features, (SELECT q, greatest(1, ceil((floor(q) + 1) / 50))::BIGINT AS w FROM (
            SELECT quantile_cont(length_of_stay_days, 0.99) AS q FROM features WHERE length_of_stay_days >= 0))
        WHERE length_of_stay_days BETWEEN 0 AND q GROUP BY ALL""",
    "los_by_outcome": f"""SELECT unplanned_readmitted_30d, avg(length_of_stay_days) AS length_of_stay_days,
        CASE unplanned_readmitted_30d {" ".join(f"WHEN {v} THEN '{t}'" for v, t in V.OUTCOME_LABELS.items())} END AS status
        FROM features GROUP BY 1""",
    "top_icd": """SELECT codigocid, count(*) AS unplanned_readmissions FROM features
        WHERE unplanned_readmitted_30d = 1 AND codigocid IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "discharge_reason_rate": _rates(f"coalesce(motivoalta, '{V.NOT_INFORMED}') AS motivoalta", least=MIN_EPISODES),
    "discharge_reason_counts": f"""SELECT {_stated("motivoalta", V.NOT_INFORMED)} AS motivoalta, count(*) AS episodes
        FROM features GROUP BY 1""",
    "hospital_specialty_rates": _CELLS,
    "hospital_specialty_heatmap": f"""SELECT executante, {", ".join(
        f"max(rate) FILTER (especialidade = '{s}') AS {s}" for s in _SPECIALTIES)} FROM ({_CELLS}) GROUP BY 1""",
    "rate_by_history": _rates("previous_hospitalizations") + " ORDER BY 1 LIMIT 30",
}


def all_oracles() -> dict[str, str]:
    return {name: _with(sql) for name, sql in _SQL.items()}


def relation_sql(name: str) -> str:
    """A shared relation over relations that already exist as tables."""
    return _RELATIONS[name].strip()


def relations_for(names: list[str]) -> list[str]:
    """The relations that must exist before the given ones, and those, in order."""
    seen: list[str] = []
    for name in names:
        _needed(f"FROM {name}", seen)
    return seen


def query_sql(name: str) -> str | None:
    """A query over stored relations, without its CTEs."""
    return _SQL.get(name)
