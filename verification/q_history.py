"""As-of history, features and exogenous data."""

from __future__ import annotations

from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.operators import collapse as C
from creekline.operators import exogenous as X
from creekline.operators import history as H
from creekline.operators import quarantine as Q
from creekline.operators.ranking import rank_correlation
from creekline.sources.sinks import staged
from verification import tables as t
from verification.registry import add
from verification.tables import sql

CORE = "target_age_days history_count last_value last3_mean history_median seasonal_site last_change month_sin month_cos".split()
DOUBLES = "last_value last3_mean history_median seasonal_site last_change month_sin month_cos"


def features(spark, sf, cross=False):
    return H.history_features(t.observations(spark, sf, names=False), t.SPECS, cross=cross)


def pick(*columns):
    def build(spark, sf):
        return features(spark, sf).filter("status = 'eligible'").select("site", "target", "date", *columns)
    return build


def picked(*columns):
    doubles = " ".join(c for c in columns if c in DOUBLES.split())
    listed = ", ".join(f"cast({c} as int) as {c}" if c == "target_age_days" else c for c in columns)
    return sql(f"select site, target, date, {listed} from elig", doubles)


add("c1_as_of_history", lambda spark, sf: t.eligible_rows(spark, sf), sql(
    "select site, target, date, issue_date, actual, cast(target_age_days as int) as target_age_days, "
    + ", ".join(c for c in CORE if c != "target_age_days") + " from elig", "actual " + DOUBLES))
for number, name in enumerate(["history_count", "last_value", "last3_mean", "history_median", "last_change", "target_age_days", "seasonal_site"]):
    add(f"e{number + 1}_{name}", pick(name), picked(name))
add("e8_month_sin_cos", pick("month_sin", "month_cos"), picked("month_sin", "month_cos"))
add("e9_eligibility", lambda spark, sf: features(spark, sf).select("site", "target", "date", "status"),
    sql("select site, target, date, status from feat"))
add("e19_issue_date", pick("issue_date"), picked("issue_date"))


def events_status(spark, sf):
    rows = H.history_features(t.event_observations(spark, sf), [], cross=False)
    return rows.groupBy("target", "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("history_count").alias("history"))


add("e9_eligibility_events", events_status, sql("""
  select target, status, count(*) as rows, cast(sum(case when status='eligible' then n end) as bigint) as history from (
    select o.target, o.n, case when n < 2 then 'fewer_than_two_available_target_samples'
      when datediff('day', last, date) > 120 then 'target_history_older_than_120_days' else 'eligible' end as status
    from (select *, count(*) over w as n, max(date) over w as last from obs_ev
      window w as (partition by site, target order by date range between unbounded preceding and interval 10 day preceding)) o)
  group by all"""))


def probes(spark, sf):
    sites = t.load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("site"))
    visits = F.sequence(F.lit("1995-02-15").cast("date"), F.lit("2002-03-15").cast("date"), F.expr("interval 1 month"))
    return sites.select("site", F.explode(visits).alias("date")).select(
        "site", "date", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("target")
    )


def c2(spark, sf):
    return H.history_features(t.observations(spark, sf, names=False), t.SPECS, probes=probes(spark, sf), cross=False).drop("actual", "month_sin", "month_cos")


PROBE = {
    "probe": """select s.site, v.date, g.target from (select cast(s_suppkey as varchar) as site from supplier) s,
      (select cast(unnest(generate_series(date '1995-02-15', date '2002-03-15', interval 1 month)) as date) as date) v,
      (select unnest(['A','N','R']) as target) g""",
    "hist": f"""select p.site, p.date, p.target, o.date as d, {t.t_sql('o.value', 'p.target')} as v
      from probe p join obs o on o.site=p.site and o.target=p.target and o.date <= p.date - interval 10 day""",
    "agg": """select site, date, target, count(*) as n, max(d) as last, arg_max(v, d) as last_value, median(v) as med,
      list(v order by d desc) as vs, count(*) filter (month(d)=month(date)) as mn, sum(v) filter (month(d)=month(date)) as ms
      from hist group by all""",
}
add("c2_as_of_probe", c2, sql("""
  select p.site, p.date, p.target, cast(p.date - interval 7 day as date) as issue_date,
    case when coalesce(n,0) < 2 then 'fewer_than_two_available_target_samples'
      when datediff('day', last, p.date) > 120 then 'target_history_older_than_120_days' else 'eligible' end as status,
    case when ok then cast(datediff('day', last, p.date) as int) end as target_age_days, case when ok then n end as history_count,
    case when ok then last_value end as last_value, case when ok then list_avg(vs[1:3]) end as last3_mean,
    case when ok then med end as history_median, case when ok then (coalesce(ms,0)+3*med)/(mn+3) end as seasonal_site,
    case when ok then vs[1]-vs[2] end as last_change
  from probe p left join (select *, n >= 2 and datediff('day', last, date) <= 120 as ok from agg) a using (site, date, target)""",
    "last_value last3_mean history_median seasonal_site last_change", extra=PROBE))

CROSS = [f"{k}_{x}" for x in "ANR" for k in ("prior", "age")]


def c3(spark, sf):
    return features(spark, sf, cross=True).filter("status = 'eligible'").select("site", "target", "date", *CROSS)


def _asof(x):
    return (f"asof left join (select site, date + interval 10 day as known, date as d{x}, {t.t_sql('value')} as v{x} from obs where target='{x}') {x} "
            f"on e.site = {x}.site and e.date >= {x}.known")


CROSS_SQL = "select e.site, e.target, e.date, " + ", ".join(
    f"case when datediff('day', d{x}, e.date) <= 120 then v{x} end as prior_{x}, "
    f"cast(case when datediff('day', d{x}, e.date) <= 120 then datediff('day', d{x}, e.date) end as int) as age_{x}" for x in "ANR"
) + " from elig e " + " ".join(_asof(x) for x in "ANR")
add("c3_cross_target_as_of", c3, sql(CROSS_SQL, "prior_A prior_N prior_R"))
add("e10_prior_age_columns", lambda spark, sf: c3(spark, sf).groupBy("target").agg(
    *[F.count(c).alias(c) for c in CROSS]), sql(
    "select target, " + ", ".join(f"count({c}) as {c}" for c in CROSS) + f" from ({CROSS_SQL}) group by target"))


def v1_tables(spark, sf):
    out = []
    for kind in ("bacteria", "chemistry"):
        raw = t.survey(spark, sf, kind)
        kept = Q.quarantine_rows(raw, t.SNAPSHOT, Q.v1_row_rules(raw, t.SNAPSHOT, kind))[0]
        # Few customers repeat within 120 days, so visits are grouped by nation-sized blocks of the site code.
        rows = Q.v1_measurements(kept, kind).withColumn("site", F.substring("site", -2, 2))
        out.append(C.v1_collapse_site_days(rows, C.V1_NUMERIC[kind]))
    return out


def e11(spark, sf):
    b, c = v1_tables(spark, sf)
    return H.v1_features(b, c)


CHEM = list(fixed.V1_CHEMISTRY)
V1 = {
    "b": f"""select right(site,2) as site, date, median({t.sql_number('Average_e_coli')}) as ecoli,
      median(case when {t.sql_number('air_temperature')} between -20 and 50 then {t.sql_number('air_temperature')} end) as air_temperature,
      median(case when {t.sql_number('water_temperature')} between 0 and 40 then {t.sql_number('water_temperature')} end) as water_temperature
      from v1judged_bacteria where reason='' group by right(site,2), date""",
    "c": "select right(site,2) as site, date, " + ", ".join(
        f"median(case when {t.sql_number(x)} between {lo} and {hi} then {t.sql_number(x)} end) as {x}" for x, (lo, hi) in fixed.V1_CHEMISTRY.items()
    ) + " from v1judged_chemistry where reason='' group by right(site,2), date",
    "bw": """select *, date - date '1970-01-01' as dn, ln(1+ecoli) as v,
      avg(ln(1+ecoli)) over (partition by site order by date rows between 2 preceding and current row) as m3,
      lag(ln(1+ecoli)) over (partition by site order by date) as prev from b""",
    "bh": """select *, count(v) over w as n, last_value(dn) over w as ldn, last_value(v) over w as lv, last_value(m3) over w as lm3,
      last_value(prev) over w as lp, quantile_cont(v, 0.5) over w as med, last_value(air_temperature) over w as la,
      last_value(water_temperature) over w as lw
      from bw window w as (partition by site order by dn range between unbounded preceding and 10 preceding)""",
}
add("e11_v1_features", e11, sql(
    """select bh.site, bh.date, cast(bh.date - interval 7 day as date) as issue_date, bh.ecoli as actual_ecoli,
      sin(2*pi()*month(bh.date)/12) as month_sin, cos(2*pi()*month(bh.date)/12) as month_cos, n as history_count,
      cast(dn - ldn as int) as bacteria_age_days, lv as last_log_ecoli, lm3 as mean_last3_log_ecoli, med as median_history_log_ecoli,
      la as last_air_temp, lw as last_water_temp, lv - lp as trend_log_ecoli, """
    + ", ".join(f"case when datediff('day', k.d, bh.date) <= 120 then k.{x} end as chem_{x}" for x in CHEM)
    + """, cast(case when datediff('day', k.d, bh.date) <= 120 then datediff('day', k.d, bh.date) end as int) as chem_age_days
    from bh asof left join (select *, date as d, date + interval 10 day as known from c) k on bh.site=k.site and bh.date >= k.known
    where n >= 2 and dn - ldn <= 120""",
    "actual_ecoli month_sin month_cos last_log_ecoli mean_last3_log_ecoli median_history_log_ecoli last_air_temp last_water_temp trend_log_ecoli "
    + " ".join(f"chem_{x}" for x in CHEM), extra=V1))
add("c4_v1_chemistry_as_of", lambda spark, sf: e11(spark, sf).groupBy("site").agg(
    F.count(F.lit(1)).alias("rows"), F.count("chem_age_days").alias("with_chemistry"), F.sum("chem_age_days").alias("age_sum"),
    F.sum("chem_ph_standard_units").alias("ph_sum")), sql(
    """select bh.site, count(*) as rows, count(*) filter (datediff('day', k.d, bh.date) <= 120) as with_chemistry,
      cast(sum(datediff('day', k.d, bh.date)) filter (datediff('day', k.d, bh.date) <= 120) as bigint) as age_sum,
      sum(k.ph_standard_units) filter (datediff('day', k.d, bh.date) <= 120) as ph_sum
    from bh asof left join (select *, date as d, date + interval 10 day as known from c) k on bh.site=k.site and bh.date >= k.known
    where n >= 2 and dn - ldn <= 120 group by bh.site""", "ph_sum", extra=V1))

# Exogenous -------------------------------------------------------------------------------

WET = """select *, day - date '1970-01-01' as dn, sum(case when rain is null then 1 else 0 end) over w30 = 0 as complete,
  sum(rain) over (order by day rows between current row and current row) as rain_1, sum(rain) over (order by day rows between 2 preceding and current row) as rain_3,
  sum(rain) over w7 as rain_7, sum(rain) over (order by day rows between 13 preceding and current row) as rain_14, sum(rain) over w30 as rain_30,
  coalesce(least((day - date '1970-01-01') - max(case when rain >= 5 then day - date '1970-01-01' end) over (order by day rows between unbounded preceding and current row), 60), 60) as dry,
  ln(1+flow) as flow_log, ln(1+avg(flow) over w7) as flow_7_log, quantile_cont(flow, 0.5) over w30 as fmed,
  case when count(rain) over w4 = 4 then sum(rain) over w4 end as rain_0_3
  from daily_d window w30 as (order by day rows between 29 preceding and current row), w7 as (order by day rows between 6 preceding and current row),
    w4 as (order by day rows between 3 preceding and current row)"""
GUARDED = """select series_id, day, rain, flow, complete, rain_0_3, """ + ", ".join(
    f"case when complete then {x} end as {y}" for y, x in [
        *[(f"rain_{n}", f"rain_{n}") for n in fixed.RAIN_WINDOWS], ("days_since_rain5", "cast(dry as double)"), ("flow_log", "flow_log"),
        ("flow_7_log", "flow_7_log"), ("flow_ratio_30", "case when fmed > 0 then flow/fmed end")]) + f" from ({WET})"
WEATHER = {"weather_d": GUARDED}
FEATURE_LIST = " ".join(fixed.WEATHER_FEATURES)


def weather(spark, sf):
    return X.daily_features(t.daily(spark, sf))


add("e12_to_e17_daily_features", weather, sql("select * from weather_d", "rain flow rain_0_3 " + FEATURE_LIST, extra=WEATHER))
for key, columns in {
    "e12_rain_sums": [f"rain_{n}" for n in fixed.RAIN_WINDOWS], "e13_days_since_rain5": ["days_since_rain5"],
    "e14_flow_logs": ["flow_log", "flow_7_log"], "e15_flow_ratio_30": ["flow_ratio_30"], "e16_missing_guard": ["complete"],
    "e17_event_window_sum": ["rain_0_3"],
}.items():
    add(key, lambda spark, sf, columns=columns: weather(spark, sf).select("day", *columns),
        sql(f"select day, {', '.join(columns)} from weather_d", " ".join(c for c in columns if c != "complete"), extra=WEATHER))


def weather_rows(spark, sf):
    table = staged(weather(spark, sf), "weather")
    rows = X.add_weather(t.eligible_rows(spark, sf).select("site", "target", "date", "issue_date", "actual", "seasonal_site"), table)
    return X.add_event_rain(rows, table)


JOINED = f"""select e.site, e.target, e.date, e.issue_date, e.actual, e.seasonal_site, {', '.join('w.' + c for c in fixed.WEATHER_FEATURES)},
  k.rain_0_3 as oracle_rain_0_3 from elig e left join weather_d w on w.day = e.issue_date - 1 left join weather_d k on k.day = e.date"""
add("c5_add_weather", weather_rows, sql(JOINED, "actual seasonal_site oracle_rain_0_3 " + FEATURE_LIST, extra=WEATHER))
add("d30_missing_rate", lambda spark, sf: X.missing_rate(weather_rows(spark, sf)), sql(
    "select count(*) as rows, avg(cast(" + " or ".join(f"{c} is null" for c in fixed.WEATHER_FEATURES)
    + f" as int)) as missing_rate from ({JOINED})", "missing_rate", extra=WEATHER))


INPUTS = ["oracle_rain_0_3", "rain_3", "rain_30", "flow_log"]


def d31(spark, sf):
    # All inputs in one pass: the input's name is part of the group.
    long = weather_rows(spark, sf).select("target", "actual", *INPUTS).unpivot(["target", "actual"], INPUTS, "input", "x")
    return rank_correlation(staged(long, "inputs"), ["target", "input"], "x", "actual")


def _spearman(x):
    return f"""select target, count(*) as samples, corr(rx, ry) as spearman, '{x}' as input from (
      select target, rank() over (partition by target order by {x}) + (count(*) over (partition by target, {x}) - 1)/2::double as rx,
        rank() over (partition by target order by actual) + (count(*) over (partition by target, actual) - 1)/2::double as ry
      from wr where {x} is not null and actual is not null) group by target"""


def _signal_sql(x, name, y):
    return f"""select target, '{x}' as input, '{name}' as "with", count(*) as samples, corr(rx, ry) as spearman from (
      select target, rank() over (partition by target order by {x}) + (count(*) over (partition by target, {x}) - 1)/2::double as rx,
        rank() over (partition by target order by y) + (count(*) over (partition by target, y) - 1)/2::double as ry
      from (select target, {x}, {y} as y from wr where {x} is not null and {y} is not null)) group by target"""


add("d31_weather_signal", lambda spark, sf: X.weather_signal(weather_rows(spark, sf), t.SPECS, INPUTS), sql(" union all ".join(
    _signal_sql(x, name, y) for x in INPUTS
    for name, y in (("outcome", t.t_sql("actual")), ("baseline_residual", f"round({t.t_sql('actual')} - seasonal_site, 9)"))
), "spearman", extra={**WEATHER, "wr": JOINED}))
add("d31_rank_correlation", d31, sql(" union all ".join(
    _spearman(x) for x in INPUTS), "spearman", extra={**WEATHER, "wr": JOINED}))
