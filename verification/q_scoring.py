"""Planned visits: grid, status, limits, what-if and overviews."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from creekline.functions.specs import limit_frame, load_limits, spec_frame, transform
from creekline.operators import errors as E
from creekline.operators import folds as D
from creekline.operators import revisions as V
from creekline.operators import scoring as G
from creekline.operators.bootstrap import REPLICATES
from creekline.operators.history import training_rows
from creekline.plans import prospective
from creekline.sources.sinks import staged
from verification import tables as t
from verification.q_errors import FOLDS_ALL, boot_sql
from verification.q_ingest import json_file
from verification.registry import add
from verification.tables import inv_sql, sql, t_sql

# A fixed model row per target: A and N forecast with baselines, R has no model yet.
REGISTRY = [
    ("A", "site_seasonal", "last_observation", 3.0, None, 3.6, 0.25, 0.2, "2000-12-21", "constant_prevalence", 0.3),
    ("N", "site_median", "last_observation", 25.0, 5.0, 45.0, 0.2, 1.1, "2000-12-21", "constant_prevalence", 2.0),
]
REG = {"reg": "select * from (values " + ", ".join(
    "(" + ", ".join("null::double" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in r) + ")" for r in REGISTRY
) + ") r(target, selected, selected_baseline, median, lower, upper, prevalence, alert_cutoff, training_end, risk_selection, test_mae)"}


def registry(spark):
    rows = [(*r[:8], datetime.date.fromisoformat(r[8]), r[9], r[10], None, None) for r in REGISTRY]
    return spark.createDataFrame(rows, G.REGISTRY_SCHEMA)


def grid(spark, sf):
    return G.predict_grid(t.observations(spark, sf, names=False), t.SPECS, t.LIMITS, registry(spark), t.VISIT)


def _base(name):
    return f"case {name} when 'global_median' then median when 'last_observation' then last_value when 'site_median' then med else seasonal_site end"


def grid_sql(obs="obs"):
    g = f"{obs}_g"
    return {
        **REG,
        g: f"""select s.site, x.target, date '{t.VISIT}' as date from (select distinct site from {obs}) s, (select unnest(['A','N','R']) as target) x""",
        f"{obs}_a": f"""select g.site, g.target, g.date, count(o.date) as n, max(o.date) as last, arg_max({t_sql('o.value', 'g.target')}, o.date) as last_value,
          median({t_sql('o.value', 'g.target')}) as med, count(*) filter (month(o.date)=month(g.date)) as mn, sum({t_sql('o.value', 'g.target')}) filter (month(o.date)=month(g.date)) as ms
          from {g} g left join {obs} o on o.site=g.site and o.target=g.target and o.date <= g.date - interval 10 day group by all""",
        f"{obs}_f": f"""select *, case when reg.training_end is null then 'insufficient_training_history' when date <= cast(training_end as date) + 10 then 'date_overlaps_training_information'
            when n < 2 then 'fewer_than_two_available_target_samples' when datediff('day', last, date) > 120 then 'target_history_older_than_120_days' else 'eligible' end as status,
          (coalesce(ms,0)+3*med)/(mn+3) as seasonal_site from {obs}_a left join reg using (target)""",
        f"{obs}_s": f"""select *, case when status='eligible' then {inv_sql('fc')} end as predicted, case when status='eligible' then {inv_sql('bs')} end as baseline,
            case when status='eligible' then {inv_sql('last_value')} end as last_in_units
          from (select *, {_base('selected')} as fc, {_base('selected_baseline')} as bs from {obs}_f)""",
        f"{obs}_l": f"""select *, case when target='A' and predicted > 30 then 'red' when target='A' and ln(1+predicted) > ln(31) - test_mae then 'yellow'
            when target='N' and predicted > 40 then 'red' when target='N' and predicted > 40 - test_mae then 'yellow'
            when target='N' and predicted < 10 then 'red' when target='N' and predicted < 10 + test_mae then 'yellow' end as limit_level,
          case when target='A' and predicted > 30 then 'above the 30 limit' when target='A' and ln(1+predicted) > ln(31) - test_mae then 'within typical forecast error of the 30 limit'
            when target='N' and predicted > 40 then 'above the 40 limit' when target='N' and predicted > 40 - test_mae then 'within typical forecast error of the 40 limit'
            when target='N' and predicted < 10 then 'below the 10 limit' when target='N' and predicted < 10 + test_mae then 'within typical forecast error of the 10 limit' end as limit_text,
          case when status='eligible' then prevalence >= alert_cutoff end as flag from {obs}_s""",
    }


GRID = grid_sql()
add("c13_scoring_grid", lambda spark, sf: G.scoring_grid(t.observations(spark, sf), t.SPECS, t.VISIT),
    sql("select site, target, date from obs_g", extra=GRID))
add("c14_spec_lookup", lambda spark, sf: t.measurements(spark, sf).join(spec_frame(spark, t.SPECS), "target", "left").groupBy("target", "label", "caution").agg(
    F.count(F.lit(1)).alias("rows")), sql("""select target, case target when 'A' then 'Flow A' when 'N' then 'Flow N' else 'Flow R' end as label,
    case target when 'R' then 'check units' else '' end as caution, count(*) as rows from long group by all"""))
add("b19_forecast_status", lambda spark, sf: grid(spark, sf).select("site", "target", "status", "reason"), sql("""
  select site, target, status, case status when 'eligible' then 'Forecast available'
    when 'fewer_than_two_available_target_samples' then 'Fewer than two earlier samples were available at issue time'
    when 'target_history_older_than_120_days' then 'Latest usable sample is more than 120 days before the visit'
    when 'insufficient_training_history' then 'Not enough history to train a forecast for this measurement'
    else 'Visit date overlaps the data the model was trained on' end as reason from obs_f""", extra=GRID))
add("b18_limit_check", lambda spark, sf: grid(spark, sf).select("site", "target", "predicted", "limit_level", "limit_text"),
    sql("select site, target, predicted, limit_level, limit_text from obs_l", "predicted", extra=GRID))
def b29(spark, sf):
    """Margins of limits read from a JSON file, and how many measurements lie past a limit or within its margin."""
    written = {"_source": "a note", "unknown": {"max": 1}} | {
        x.target: {"basis": x.basis, **({"min": x.min} if x.min is not None else {}), **({"max": x.max} if x.max is not None else {})} for x in t.LIMITS
    }
    limits = load_limits(spark, json_file(spark, written, "b29"), t.SPECS)
    joined = t.measurements(spark, sf).join(G.limit_margins(limits, registry(spark)), "target").join(limit_frame(spark, limits), "target")
    moved = {name: transform(t.SPECS, F.col("target"), F.col(name)) for name in ("value", "min", "max")}
    near = (moved["value"] > moved["max"] - F.col("margin")) | (moved["value"] < moved["min"] + F.col("margin"))
    return joined.groupBy("target", "margin").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(near, F.lit(False))).alias("near"))


add("b29_limit_margin", b29, sql("""
  select target, coalesce(test_mae, 0) as margin, count(*) as rows, count(*) filter (case target when 'A' then ln(1+value) > ln(31) - test_mae
    when 'N' then value > 40 - test_mae or value < 10 + test_mae else value < 20 end) as near
  from long left join reg using (target) group by target, coalesce(test_mae, 0)""", "margin", extra=REG))
add("i14_predict_grid", lambda spark, sf: grid(spark, sf).select(
    "site", "target", "date", "issue_date", "status", "predicted", "experimental_tail_probability", "flag", "age_days", "selected_model", "risk_model"), sql("""
  select site, target, date, cast(date - interval 7 day as date) as issue_date, status, predicted, case when status='eligible' then prevalence end as experimental_tail_probability,
    flag, case when status='eligible' then cast(datediff('day', last, date) as int) end as age_days, case when status='eligible' then selected end as selected_model,
    case when status='eligible' then risk_selection end as risk_model from obs_l""", "predicted experimental_tail_probability", extra=GRID))
add("i15_score_with_context", lambda spark, sf: grid(spark, sf).select(
    "site", "target", "status", "predicted", "baseline", "last_value", "age_days", "flag", "uses_baseline", "limit_level", "limit_text"), sql("""
  select site, target, status, predicted, baseline, last_in_units as last_value, case when status='eligible' then cast(datediff('day', last, date) as int) end as age_days,
    flag, case when status='eligible' then true end as uses_baseline, limit_level, limit_text from obs_l""", "predicted baseline last_value", extra=GRID))
add("i10b_risk_flag", lambda spark, sf: grid(spark, sf).groupBy("target", "flag").agg(F.count(F.lit(1)).alias("rows")),
    sql("select target, flag, count(*) as rows from obs_l group by all", extra=GRID))
add("d22_site_overview", lambda spark, sf: G.site_overview(grid(spark, sf), t.SPECS), sql("""
  select site, count(*) filter (status='eligible') as eligible_targets, count(*) filter (status<>'eligible') as unavailable_targets,
    coalesce(string_agg(target, ';' order by target) filter (flag), '') as flagged_targets, 'Correlated target flags; no combined safety score.' as note
  from obs_l group by site""", extra=GRID))
add("d24_forecast_summary", lambda spark, sf: G.forecast_summary(grid(spark, sf)), sql("""
  select count(*) filter (status='eligible') as forecasts, count(distinct site) as sites, count(*) filter (limit_level='red') as red,
    count(*) filter (limit_level='yellow') as yellow, count(*) filter (status<>'eligible') as unavailable from obs_l""", extra=GRID))
LEVELS = {**GRID, "lev": """select site, bool_or(status='eligible') as has_forecast,
  case when bool_or(coalesce(limit_level='red', false)) then 'red' when bool_or(coalesce(limit_level='yellow', false)) then 'yellow' else '' end as level from obs_l group by site""",
  "nam": "select site, arg_min(name, row(-n, name)) as name from (select site, trim(w[2]) as name, count(*) as n from obs group by all) group by site"}
add("d24_site_levels", lambda spark, sf: G.site_levels(grid(spark, sf)), sql("select * from lev", extra=LEVELS))
add("d23_site_names", lambda spark, sf: G.site_names(t.observations(spark, sf)), sql("select * from nam", extra=LEVELS))


def b27(spark, sf):
    obs = staged(t.observations(spark, sf), "obs")
    levels = G.site_levels(G.predict_grid(obs, t.SPECS, t.LIMITS, registry(spark), t.VISIT))
    return G.overview_filter(levels, G.site_names(obs), "1", "flagged")


add("b27_overview_filter", b27, sql("select * from lev join nam using (site) where level <> '' and (contains(site, '1') or contains(lower(name), '1'))", extra=LEVELS))
add("d25_site_backtest", lambda spark, sf: G.site_backtest(t.predictions(spark, sf)), sql("""
  select site, target, count(*) as tested, avg(abs(actual-predicted)) as model_miss, avg(abs(actual-baseline_predicted)) as baseline_miss from pred group by all""",
    "model_miss baseline_miss"))
add("d26_freshness", lambda spark, sf: G.freshness(t.observations(spark, sf)), sql("""
  select max(last) as last_sample, cast(max(last) + interval 120 day as date) as latest_useful_date, count(*) as sites, cast(sum(n) as bigint) as samples,
    arg_min(site, row(-n, site)) as busiest_site from (select site, count(*) as n, max(date) as last from obs group by site)"""))
add("d26_samples_per_site", lambda spark, sf: G.samples_per_site(t.observations(spark, sf)), sql("select site, count(*) as samples from obs group by site"))


def b22(spark, sf):
    rows = t.load(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise(F.concat(F.col("l_returnflag"), F.when(F.col("l_tax") > 0.06, "x").otherwise(""))).alias("target"),
        (F.col("l_quantity") * 1.25 - 3).alias("value"),
    )
    return G.validate_scenario(rows, t.SPECS).groupBy("target", "problem").agg(F.count(F.lit(1)).alias("rows"))


add("b22_validate_scenario", b22, sql("""
  select target, case when target not in ('A','N','R') then 'unknown measurement' when value < 0 or (target='N' and value > 50)
    then 'Flow ' || target || ' value is outside the allowed range' else '' end as problem, count(*) as rows
  from (select case when l_linestatus='F' then l_returnflag else l_returnflag || case when l_tax>0.06 then 'x' else '' end end as target, l_quantity*1.25-3 as value from lineitem) group by all"""))


def added(spark, sf):
    """A hypothetical late sample of N at every site, from its supplier's balance."""
    return t.load(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("site"), F.lit("2001-11-05").cast("date").alias("date"), F.lit("N").alias("target"),
        F.least(F.greatest(F.floor(F.col("s_acctbal") / 250), F.lit(0)), F.lit(50)).cast("double").alias("value"),
    )


def i21(spark, sf):
    return G.what_if(staged(t.observations(spark, sf, names=False), "obs"), added(spark, sf), t.SPECS, t.LIMITS, registry(spark), t.VISIT)


WHATIF = {"add_n": "select cast(s_suppkey as varchar) as site, date '2001-11-05' as date, 'N' as target, cast(least(greatest(floor(s_acctbal/250),0),50) as double) as value from supplier",
          "obs2": """select site, date, target, value from obs where not exists (select 1 from add_n a where a.site=obs.site and a.date=obs.date and a.target=obs.target) union all select * from add_n""",
          **GRID, **grid_sql("obs2")}
add("i21_what_if", i21, sql("""
  select site, target, a.predicted as predicted_before, a.status as status_before, a.limit_level as limit_level_before, b.predicted as predicted_after, b.status as status_after,
    b.limit_level as limit_level_after, b.predicted - a.predicted as change from obs_l a full join obs2_l b using (site, target)""", "predicted_before predicted_after change", extra=WHATIF))


def i22(spark, sf):
    obs = staged(t.observations(spark, sf), "obs")
    return G.site_history(obs, t.predictions_from(training_rows(obs, t.SPECS, cross=False)), "7", "A")


add("i22_site_history", i22, sql("""
  select 'observation' as kind, date, value as actual, null::double as predicted, null::double as baseline from obs where site='7' and target='A'
  union all select 'tested', date, actual, predicted, baseline_predicted from pred where site='7' and target='A'""", "actual predicted baseline"))


def i20(spark, sf):
    """Frozen baselines on samples from 2001 on: all sites, and without some sites."""
    rows = staged(t.eligible_rows(spark, sf).filter("date >= '2001-01-01'"), "new_rows").withColumn("regressed", F.lit(None).cast("double"))
    every, scored = prospective.judge(rows, registry(spark), t.SPECS, "all_sites", REPLICATES)
    kept, _ = prospective.judge(V.exclude_sites(rows, ["3", "7", "11"]), registry(spark), t.SPECS, "excluding_site_conflicts", REPLICATES)
    return every.unionByName(kept).select(
        "target", "fold", "observations", F.col("model_transformed_MAE").alias("model_MAE"), F.col("baseline_transformed_MAE").alias("baseline_MAE"),
        "sites", "mean_gain", "lower_95", "upper_95", "verdict",
    )


FROZEN = {
    **REG,
    "fz": f"""select e.target, w as fold, site, {t_sql('actual', 'e.target')} as y, last_value as b, case when e.target='A' then seasonal_site else history_median end as f
      from elig e, (select unnest(['all_sites', 'excluding_site_conflicts']) as w) where date >= date '2001-01-01' and e.target in ('A','N') and (w='all_sites' or site not in ('3','7','11'))""",
    **boot_sql("select target, fold, site, abs(y-b)-abs(y-f) as gain from fz", ["target", "fold"], REPLICATES),
}
# The frozen forecasts are baselines themselves, so there is no gain to confirm.
add("i20_score_frozen", i20, sql("""
  select *, 'frozen_model_is_baseline' as verdict
  from (select target, fold, count(*) as observations, avg(abs(y-f)) as model_MAE, avg(abs(y-b)) as baseline_MAE from fz group by all) join boot using (target, fold)""",
    "model_MAE baseline_MAE mean_gain lower_95 upper_95", extra=FROZEN))


def i20_protocol(spark, sf):
    """What a run may claim, where some measurements were changed, removed and added since the models were frozen."""
    new = staged(t.observations(spark, sf), "obs")
    site = F.col("site").cast("int")
    old = new.filter(site % 7 != 3).withColumn("value", F.when(site % 5 == 2, F.col("value") + 1).otherwise(F.col("value")))
    gone = new.filter(site % 11 == 4).withColumn("date", F.date_add("date", -20_000))
    return prospective.protocol(old.unionByName(gone), new, "0" * 64, "2000-06-01", t.VISIT, "1999-12-31")


add("i20_protocol", i20_protocol, sql("""select repeat('0', 64) as models_sha256, date '2000-06-01' as start, date '2001-11-20' as snapshot_date,
  false as reproduction_check_only,
  count(*) filter (date <= date '1999-12-31' and cast(site as int) % 7 <> 3 and cast(site as int) % 5 <> 2) as unchanged,
  count(*) filter (date <= date '1999-12-31' and cast(site as int) % 7 <> 3 and cast(site as int) % 5 = 2) as changed,
  count(*) filter (date > date '1999-12-31' and cast(site as int) % 7 <> 3) + count(*) filter (cast(site as int) % 11 = 4) as removed,
  count(*) filter (date <= date '1999-12-31' and cast(site as int) % 7 = 3) as added from obs"""))


def i23(spark, sf):
    rows = staged(t.eligible_rows(spark, sf), "rows")
    support = D.fold_support(D.fold_rows(rows, t.FOLD_YEARS))
    summary = D.target_summary(spec_frame(spark, t.SPECS), support, D.baseline_evaluation(rows, t.SPECS, t.FOLD_YEARS, REPLICATES), "2001")
    return G.target_catalog(spec_frame(spark, t.SPECS), summary, registry(spark), limit_frame(spark, t.LIMITS))


add("i23_target_catalog", i23, sql("""
  select x.target, x.label, null::varchar as unit, x.target = 'A' as log, status, selected as selected_model, selected_baseline as baseline,
    improvement_percent, lower_95, upper_95, sup.test, source_MAE, false as flags, '' as note, caution, limit_min, limit_max, limit_basis
  from (values ('A', 'Flow A', '', null::double, 30::double, 'upper'), ('N', 'Flow N', '', 10::double, 40::double, 'band'),
    ('R', 'Flow R', 'check units', 20::double, null::double, 'lower')) x(target, label, caution, limit_min, limit_max, limit_basis)
  join (select * from evb where fold='2001') e using (target) join sup on sup.target = x.target and sup.fold='2001'""",
    "improvement_percent lower_95 upper_95 source_MAE", extra=FOLDS_ALL))
