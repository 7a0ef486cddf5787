"""How the given tables stand in for monitoring data, in Spark and, side by side, in SQL.

lineitem: replicated measurements of three targets at many sites over seven years.
orders:   a survey export with malformed rows and cells, and a daily rain/flow table.
events:   a short, dense record (most visits lack history).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creekline.functions.specs import LimitSpec, TargetSpec, default_specs, inverse
from creekline.operators.collapse import collapse_replicates
from creekline.operators.errors import error_columns, risk_label, tail_thresholds
from creekline.operators.exogenous import calendar_spine
from creekline.operators.history import training_rows
from creekline.sources.sinks import staged

SPECS = [
    TargetSpec("A", "survey", "a", "Flow A", "log1p", "high", 0.0, None),
    TargetSpec("N", "survey", "n", "Flow N", "identity", "both", 0.0, 50.0),
    TargetSpec("R", "survey", "r", "Flow R", "identity", "low", 0.0, None, "check units"),
]
LIMITS = [LimitSpec("A", None, 30.0, "upper"), LimitSpec("N", 10.0, 40.0, "band"), LimitSpec("R", 20.0, None, "lower")]
TRAIN_BEFORE = "1999-12-22"
VALIDATION = ("2000-01-01", "2000-12-21")
FOLD_YEARS = [1999, 2000, 2001]
SNAPSHOT = "1999-12-31"
VISIT = "2001-11-20"
FLAG_AT = 0.15
DIGITS = 6


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(name: str, digits: int) -> Column:
    """``F.round`` of a double, which writes each number as decimal text first. That is needed only where a number is
    large or its rest lies so close to a half that a product's last digits decide; else whole numbers give the same."""
    value, scale = F.col(f"`{name}`"), F.lit(10.0**digits)
    size = F.abs(value) * scale
    whole = F.floor(size)
    rest = size - whole
    clear = (size < F.lit(2.0**40)) & (F.abs(rest - 0.5) > 0.001)
    near = F.when(rest > 0.5, whole + 1).otherwise(whole) / scale
    return F.when(clear, F.when(value < 0, -near).otherwise(near)).otherwise(F.round(value, digits))


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles so that two engines' last digits do not matter; -0.0 becomes 0.0."""
    return df.select(
        *[
            (rounded(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- lineitem as measurements -------------------------------------------------------------


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("site"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("target"),
        F.col("l_quantity").alias("value"),
        F.col("l_linestatus").alias("waterbody"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("csv_line"),
    )


def observations(spark: SparkSession, sf: str, names: bool = True) -> DataFrame:
    return collapse_replicates(measurements(spark, sf), names=names)


def event_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("site"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("target"),
        "value",
        F.col("event_type").alias("waterbody"),
        F.col("event_id").alias("csv_line"),
    )
    return collapse_replicates(rows, names=False)


def eligible_rows(spark: SparkSession, sf: str, cross: bool = False) -> DataFrame:
    return training_rows(observations(spark, sf, names=False), SPECS, cross=cross)


def predictions_from(rows: DataFrame) -> DataFrame:
    """Predictions that SQL can repeat: seasonal forecast, median baseline, a rational score."""
    rows = staged(rows, "rows")
    limits = tail_thresholds(rows.filter(F.col("date") < F.lit(TRAIN_BEFORE).cast("date")), SPECS)
    score = F.col("target_age_days") / (F.col("target_age_days") + F.col("history_count"))
    target = F.col("target")
    return rows.join(limits, "target").select(
        "site", "date", "issue_date", "actual", "target_age_days", "target",
        inverse(SPECS, target, F.col("seasonal_site")).alias("predicted"),
        inverse(SPECS, target, F.col("history_median")).alias("baseline_predicted"),
        score.alias("experimental_tail_probability"),
        risk_label(F.col("actual"), F.col("lower"), F.col("upper")).alias("actual_tail_event"),
        (score >= FLAG_AT).alias("experimental_flag"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predictions_from(eligible_rows(spark, sf))


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return error_columns(predictions(spark, sf), SPECS)


# --- orders as a survey export ------------------------------------------------------------

# Text measurements per target as a divisor of the order's price.
PRICE_DIVISORS = {
    "ecoli": 1000, "other_coliform": 1, "water_temperature": 10000, "dissolved_oxygen": 9000,
    "oxygen_saturation": 1500, "ph": 30000, "conductivity": 700, "nitrate": 40000, "phosphate": 50000,
    "turbidity_reported": 25000, "turbidity_legacy": 20000, "suspended_solids": 8000,
    "alkalinity": 2500, "hardness": 3500, "salinity": 60000,
}


def survey(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """An export with deterministic faults, chosen by order status and priority."""
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")

    def case(p: str, s: str) -> Column:
        return (priority == p) & (status == s)

    key = F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    created = F.date_format(F.date_add(F.to_date("o_orderdate"), 45), "M/d/yyyy")
    whole = {
        name: F.floor(price / divisor).cast("bigint").cast("string") for name, divisor in PRICE_DIVISORS.items()
    }
    columns = [
        F.when(case("2-HIGH", "F"), "1.0d").when(case("3-MEDIUM", "F"), "").when(
            case("4-NOT SPECIFIED", "F"), "inf"
        ).otherwise(F.concat(F.lit(" "), whole[s.target])).alias(s.column)
        if s.target in ("ecoli", "ph")
        else whole[s.target].alias(s.column)
        for s in default_specs()
        if s.source == source
    ]
    return load(spark, sf, "orders").select(
        F.lit(source).alias("source"),
        (F.col("o_orderkey") + 2).alias("csv_line"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("globalid"),
        F.when(case("1-URGENT", "P"), F.concat(F.lit("X"), F.lpad(key, 7, "0")))
        .when(case("2-HIGH", "P"), F.lpad(key, 6, "0"))
        .when(case("3-MEDIUM", "P"), F.lpad(key, 13, "0"))
        .otherwise(F.lpad(key, 7, "0")).alias("gww_site_code_double"),
        F.when(case("4-NOT SPECIFIED", "P"), "yesterday")
        .otherwise(F.concat(created, F.lit(" 22:00:00.000"))).alias("CreationDate"),
        F.when(case("5-LOW", "P"), "2/30/1998 0:00:00.000")
        .when(priority == "1-URGENT", F.concat(day, F.lit(" 13:30:15.25")))
        .otherwise(F.concat(day, F.lit(" 0:00:00.000"))).alias("sample_date_time"),
        status.alias("watershed"),
        F.when(status == "P", "").otherwise(priority).alias("waterbody"),
        F.when(priority == "5-LOW", "").otherwise(F.concat(F.lit("Bridge #"), F.floor(price / 250000).cast("string"))).alias("Site_Location"),
        F.when(case("1-URGENT", "F"), key).otherwise("").alias("_c20"),
        *columns,
        F.floor(price / 12000).cast("bigint").cast("string").alias("air_temperature"),
        *([whole["water_temperature"].alias("water_temperature")] if source == "bacteria" else []),
        F.when(status == "O", "Turbidity meter").when(status == "F", "Tube").otherwise("").alias("turbidity_tube_or_meter"),
    )


# --- orders as daily rain and flow --------------------------------------------------------


def rain(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(
        F.lit("all").alias("series_id"), F.to_date("o_orderdate").alias("day")
    ).agg((F.avg("o_totalprice") / 50000).alias("rain"))


def flow(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(
        F.lit("all").alias("series_id"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count(F.lit(1)).cast("double").alias("flow"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return calendar_spine(rain(spark, sf), flow(spark, sf))


# --- the same in SQL ----------------------------------------------------------------------

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def sql_number(x: str) -> str:
    return f"(case when regexp_full_match(trim({x}), '{NUMBER}') then try_cast(trim({x}) as double) end)"


def sql_time(x: str) -> str:
    return f"try_strptime({x}, '%m/%d/%Y %H:%M:%S.%f')"


def t_sql(value: str, target: str = "target") -> str:
    return f"(case when {target}='A' then ln(1+{value}) else {value} end)"


def inv_sql(value: str, target: str = "target") -> str:
    """Clipped inverse; greatest/least skip NULL in DuckDB, so NULL is kept by hand."""
    return (
        f"(case when {value} is null then null when {target}='A' then greatest(exp({value})-1, 0) "
        f"when {target}='N' then greatest(least({value}, 50), 0) else greatest({value}, 0) end)"
    )


def _survey_sql(source: str) -> str:
    def case(p: str, s: str) -> str:
        return f"o_orderpriority='{p}' and o_orderstatus='{s}'"

    key = "cast(o_custkey as varchar)"
    cells = []
    for s in default_specs():
        if s.source != source:
            continue
        whole = f"cast(cast(floor(o_totalprice/{PRICE_DIVISORS[s.target]}) as bigint) as varchar)"
        if s.target in ("ecoli", "ph"):
            whole = (
                f"case when {case('2-HIGH', 'F')} then '1.0d' when {case('3-MEDIUM', 'F')} then '' "
                f"when {case('4-NOT SPECIFIED', 'F')} then 'inf' else ' ' || {whole} end"
            )
        cells.append(f"{whole} as {s.column}")
    if source == "bacteria":
        cells.append("cast(cast(floor(o_totalprice/10000) as bigint) as varchar) as water_temperature")
    day = "strftime(o_orderdate, '%-m/%-d/%Y')"
    created = "strftime(o_orderdate + interval 45 day, '%-m/%-d/%Y')"
    return f"""
select '{source}' as source, o_orderkey+2 as csv_line, 'o' || cast(o_orderkey as varchar) as globalid,
  case when {case('1-URGENT', 'P')} then 'X' || lpad({key},7,'0') when {case('2-HIGH', 'P')} then lpad({key},6,'0')
       when {case('3-MEDIUM', 'P')} then lpad({key},13,'0') else lpad({key},7,'0') end as gww_site_code_double,
  case when {case('4-NOT SPECIFIED', 'P')} then 'yesterday' else {created} || ' 22:00:00.000' end as CreationDate,
  case when {case('5-LOW', 'P')} then '2/30/1998 0:00:00.000'
       when o_orderpriority='1-URGENT' then {day} || ' 13:30:15.25' else {day} || ' 0:00:00.000' end as sample_date_time,
  o_orderstatus as watershed, case when o_orderstatus='P' then '' else o_orderpriority end as waterbody,
  case when o_orderpriority='5-LOW' then '' else 'Bridge #' || cast(cast(floor(o_totalprice/250000) as bigint) as varchar) end as Site_Location,
  case when {case('1-URGENT', 'F')} then {key} else '' end as _c20,
  {', '.join(cells)},
  cast(cast(floor(o_totalprice/12000) as bigint) as varchar) as air_temperature,
  case when o_orderstatus='O' then 'Turbidity meter' when o_orderstatus='F' then 'Tube' else '' end as turbidity_tube_or_meter
from orders"""


def _judged_sql(source: str, v1: bool = False) -> str:
    names = ("shifted_or_invalid_metadata", "sample_after_export_date") if v1 else (
        "invalid_or_shifted_metadata", "sample_after_snapshot")
    extra = ""
    if v1 and source == "bacteria":
        number = sql_number("Average_e_coli")
        extra = f" || case when {number} is null or {number} < 0 then 'missing_or_negative_target;' else '' end"
    return f"""
select *, gww_site_code_double as site, cast({sql_time('sample_date_time')} as date) as date,
  case when _c20 <> '' then 'nonempty_extra_columns;' else '' end
  || case when not regexp_full_match(gww_site_code_double, '[0-9]{{7,12}}') then 'invalid_site_identifier;' else '' end
  || case when not regexp_matches(CreationDate, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} ') then '{names[0]};' else '' end
  || case when {sql_time('sample_date_time')} is null then 'invalid_date;' else '' end
  || case when coalesce(cast({sql_time('sample_date_time')} as date) > date '{SNAPSHOT}', false) then '{names[1]};' else '' end
  {extra} as reason
from raw_{source}"""


def _cells_sql(source: str) -> str:
    parts = []
    for s in default_specs():
        if s.source != source:
            continue
        low = "-1e308" if s.min is None else f"cast({s.min} as double)"
        high = "1e308" if s.max is None else f"cast({s.max} as double)"
        parts.append(
            f"select source, csv_line, site, date, waterbody, '{s.target}' as target, trim({s.column}) as text, "
            f"{low} as lo, {high} as hi from good_{source}"
        )
    return (
        f"select *, (text <> '' and not coalesce(value between lo and hi, false)) as bad from "
        f"(select *, {sql_number('text')} as value from ({' union all '.join(parts)}))"
    )


def _features_sql() -> str:
    return f"""
select site, target, date, date - interval 7 day as issue_at, value as actual, cnt,
  dn - lastdn as target_age_days, cnt as history_count, lastv as last_value, lastm3 as last3_mean, med as history_median,
  (coalesce(msum,0) + 3*med) / (mcnt + 3) as seasonal_site, lastv - lastprev as last_change,
  sin(2*pi()*month(date)/12) as month_sin, cos(2*pi()*month(date)/12) as month_cos,
  case when cnt < 2 then 'fewer_than_two_available_target_samples'
       when dn - lastdn > 120 then 'target_history_older_than_120_days' else 'eligible' end as status
from (
  select *, count(v) over w as cnt, last_value(dn) over w as lastdn, last_value(v) over w as lastv,
    last_value(m3) over w as lastm3, last_value(prev) over w as lastprev, quantile_cont(v, 0.5) over w as med,
    sum(v) over wm as msum, count(v) over wm as mcnt
  from (
    select *, avg(v) over (partition by site,target order by dn rows between 2 preceding and current row) as m3,
      lag(v) over (partition by site,target order by dn) as prev
    from (select *, {t_sql('value')} as v, date - date '1970-01-01' as dn from obs)
  )
  window w as (partition by site,target order by dn range between unbounded preceding and 10 preceding),
         wm as (partition by site,target,month(date) order by dn range between unbounded preceding and 10 preceding)
)"""


# Named pieces in order of dependence; a statement takes those it mentions, directly or not.
CTES = {
    "long": "select cast(l_suppkey as varchar) as site, cast(l_shipdate as date) as date, l_returnflag as target, "
            "l_quantity as value, l_linestatus as waterbody, l_orderkey*8+l_linenumber as csv_line from lineitem",
    "obs": "select site, date, target, median(value) as value, min(row(csv_line, waterbody)) as w, count(*) as replicate_rows "
           "from long group by all",
    "obs_ev": "select cast(user_id as varchar) as site, cast(ts as date) as date, event_type as target, median(value) as value, "
              "count(*) as replicate_rows from events group by all",
    "feat": _features_sql(),
    "elig": "select * exclude (issue_at, cnt), cast(issue_at as date) as issue_date from feat where status='eligible'",
    "thr": f"""select target, case when target='N' then quantile_cont(actual,0.1) when target='R' then quantile_cont(actual,0.25) end as lower,
      case when target='N' then quantile_cont(actual,0.9) when target='A' then quantile_cont(actual,0.75) end as upper
      from elig where date < date '{TRAIN_BEFORE}' group by target""",
    "pred": f"""select site, date, issue_date, actual, cast(target_age_days as int) as target_age_days, target,
      {inv_sql('seasonal_site')} as predicted, {inv_sql('history_median')} as baseline_predicted,
      cast(target_age_days as double)/(target_age_days+history_count) as p,
      cast(coalesce(actual < lower, false) or coalesce(actual > upper, false) as int) as event,
      cast(target_age_days as double)/(target_age_days+history_count) >= cast({FLAG_AT} as double) as flag
      from elig join thr using (target)""",
    "err": f"""select *, abs({t_sql('actual')} - {t_sql('predicted')}) as error,
      abs({t_sql('actual')} - {t_sql('baseline_predicted')}) as baseline_error, abs(actual-predicted) as source_error,
      cast(year(date) as int) as year from pred""",
    "raw_bacteria": _survey_sql("bacteria"),
    "raw_chemistry": _survey_sql("chemistry"),
    "judged_bacteria": _judged_sql("bacteria"),
    "judged_chemistry": _judged_sql("chemistry"),
    "v1judged_bacteria": _judged_sql("bacteria", v1=True),
    "v1judged_chemistry": _judged_sql("chemistry", v1=True),
    "good_bacteria": "select * from judged_bacteria where reason=''",
    "good_chemistry": "select * from judged_chemistry where reason=''",
    "cells_bacteria": _cells_sql("bacteria"),
    "cells_chemistry": _cells_sql("chemistry"),
    "rain_d": "select 'all' as series_id, cast(o_orderdate as date) as day, avg(o_totalprice)/50000 as rain from orders group by all",
    "flow_d": "select 'all' as series_id, cast(o_orderdate as date) as day, cast(count(*) as double) as flow from orders group by all",
    "daily_d": """select 'all' as series_id, d.day, rain, flow from
      (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from
        (select day from rain_d union all select day from flow_d)) d
      left join rain_d using (day) left join flow_d using (day)""",
}


def sql(select: str, doubles: str = "", digits: int = DIGITS, extra: dict[str, str] | None = None) -> str:
    """The statement with the pieces it needs, its listed double columns rounded like ``tidy``."""
    pieces = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in pieces:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(pieces[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    order = sorted(needed, key=list(pieces).index)
    head = f"with {', '.join(f'{n} as ({pieces[n]})' for n in order)} " if order else ""
    body = f"select * from ({select})"
    if doubles:
        rounded = ", ".join(f"round({c}, {digits}) + 0.0::double as {c}" for c in doubles.split())
        body = f"select * replace ({rounded}) from ({select})"
    return head + body
