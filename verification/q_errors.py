"""Errors, segments, ranking metrics, bootstrap and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.scalar import is_close
from creekline.functions.specs import spec_frame
from creekline.operators import bootstrap as B
from creekline.operators import errors as E
from creekline.operators import folds as D
from creekline.operators import ranking as R
from creekline.sources.sinks import staged
from verification import tables as t
from verification.registry import add
from verification.tables import sql

SUMMARY = "samples sites MAE_transformed baseline_MAE_transformed improvement_percent source_MAE source_bias events caught missed false_flags recall precision".split()
SUM_DOUBLES = "MAE_transformed baseline_MAE_transformed improvement_percent source_MAE source_bias recall precision"


def summary_sql(keys, table, where="true"):
    return f"""select {keys}, count(*) filter ({where}) as samples, count(distinct site) filter ({where}) as sites,
  avg(error) filter ({where}) as MAE_transformed, avg(baseline_error) filter ({where}) as baseline_MAE_transformed,
  100*(sum(baseline_error) filter ({where})-sum(error) filter ({where}))/nullif(sum(baseline_error) filter ({where}),0) as improvement_percent,
  avg(source_error) filter ({where}) as source_MAE, avg(predicted-actual) filter ({where}) as source_bias,
  cast(sum(event) filter ({where}) as bigint) as events, cast(sum(event*flag::int) filter ({where}) as bigint) as caught,
  cast(sum(event*(1-flag::int)) filter ({where}) as bigint) as missed, cast(sum((1-event)*flag::int) filter ({where}) as bigint) as false_flags,
  sum(event*flag::int) filter ({where})/nullif(sum(event) filter ({where}),0)::double as recall,
  sum(event*flag::int) filter ({where})/nullif(sum(flag::int) filter ({where}),0)::double as precision
  from {table} group by {keys}"""


PRED_COLUMNS = """site, date, issue_date, actual, target_age_days, target, predicted, baseline_predicted,
  p as experimental_tail_probability, event as actual_tail_event, flag as experimental_flag"""
PRED_DOUBLES = "actual predicted baseline_predicted experimental_tail_probability"
add("i13_heldout_predictions", t.predictions, sql(f"select {PRED_COLUMNS} from pred", PRED_DOUBLES))
add("i6_baseline_forecast", lambda spark, sf: t.predictions(spark, sf).select("site", "target", "date", "predicted", "baseline_predicted"),
    sql("select site, target, date, predicted, baseline_predicted from pred", "predicted baseline_predicted"))
add("b17_risk_label", lambda spark, sf: t.predictions(spark, sf).groupBy("target", "actual_tail_event").agg(F.count(F.lit(1)).alias("rows")),
    sql("select target, event as actual_tail_event, count(*) as rows from pred group by all"))
add("b28_error_columns", t.errors, sql(
    f"select {PRED_COLUMNS}, error, baseline_error, source_error, year from err", PRED_DOUBLES + " error baseline_error source_error"))
add("d5_error_summary", lambda spark, sf: E.error_summary(t.errors(spark, sf), ["target"]), sql(summary_sql("target", "err"), SUM_DOUBLES))
add("b11_is_close", lambda spark, sf: t.measurements(spark, sf).select(
    "csv_line", "value", is_close(F.col("value"), F.round(F.col("value") / 7) * 7, 0.01, 0.5).alias("close")),
    sql("select csv_line, value, abs(value - round(value/7)*7) <= 0.5::double + 0.01::double*abs(round(value/7)*7) as close from long", "value"))


def segmented(spark, sf):
    rows = staged(t.eligible_rows(spark, sf), "rows")
    errors = E.segment_columns(E.error_columns(t.predictions_from(rows), t.SPECS))
    errors = E.extreme_group(errors, rows, t.TRAIN_BEFORE)
    return E.seen_in_fit(errors, rows, t.TRAIN_BEFORE, t.VALIDATION)


SEG = {
    "ext": f"select target, quantile_cont(actual, 0.05) as low, quantile_cont(actual, 0.95) as high from elig where date < date '{t.TRAIN_BEFORE}' group by target",
    "fit": f"select distinct site, target, true as s from elig where date < date '{t.TRAIN_BEFORE}' or date between date '{t.VALIDATION[0]}' and date '{t.VALIDATION[1]}'",
    "seg": """select err.*, case when month(date) in (12,1,2) then 'winter' when month(date) in (3,4,5) then 'spring' when month(date) in (6,7,8) then 'summer' else 'autumn' end as season,
      case when target_age_days <= 35 then '10–35 days' when target_age_days <= 60 then '36–60 days' else '61–120 days' end as history_age,
      case when event=1 then 'historical_tail_event' else 'ordinary_result' end as event_group,
      case when actual < low or actual > high then 'outside_training_5th_95th_percentiles' else 'within_training_5th_95th_percentiles' end as extreme_group,
      case when s then 'seen_in_model_fit' else 'unseen_in_model_fit' end as site_training_status
      from err join ext using (target) left join fit using (site, target)""",
}
SEG_COLUMNS = "site, target, date, season, history_age, event_group, extreme_group, site_training_status"


def seg_query(*columns):
    return lambda spark, sf: segmented(spark, sf).select("site", "target", "date", *columns)


for key, column in {
    "b13_season": "season", "b14_history_age_bucket": "history_age", "b15_event_group": "event_group",
    "b16_extreme_group": "extreme_group", "c11_seen_in_fit": "site_training_status",
}.items():
    add(key, seg_query(column), sql(f"select site, target, date, {column} from seg", extra=SEG))
add("d6_segment_errors", lambda spark, sf: E.segment_errors(segmented(spark, sf)), sql(
    "select *, samples < 20 as small_sample from (" + " union all by name ".join(
        f"(select *, '{d}' as dimension from ({summary_sql('target, segment', f'(select *, cast({d} as varchar) as segment from seg)')}))"
        for d in E.DIMENSIONS) + ")", SUM_DOUBLES, extra=SEG))


def scored(spark, sf):
    rows = t.eligible_rows(spark, sf)
    return rows.select("target", "actual", "seasonal_site", "history_median")


add("d7_regression_metrics", lambda spark, sf: E.regression_metrics(scored(spark, sf), ["target"], "seasonal_site", t.SPECS), sql(f"""
  select target, avg(abs({t.t_sql('actual')} - seasonal_site)) as transformed_MAE,
    avg(abs(actual - {t.inv_sql('seasonal_site')})) as source_MAE from elig group by target""", "transformed_MAE source_MAE"))
add("d7_v1_regression_metrics", lambda spark, sf: E.v1_regression_metrics(
    t.eligible_rows(spark, sf).filter("target = 'A'").select("target", F.col("actual").alias("actual_ecoli"), "history_median"), ["target"], "history_median"), sql("""
  select target, avg(abs(ln(1+actual)-history_median)) as log_MAE, sqrt(avg((ln(1+actual)-history_median)**2)) as log_RMSE,
    avg(abs(actual - greatest(0, exp(history_median)-1))) as raw_MAE from elig where target='A' group by target""", "log_MAE log_RMSE raw_MAE"))

RANK = {
    "sc": "select target, p, sum(event)::double as pos, sum(1-event)::double as neg from pred group by all",
    "cum": """select *, sum(pos) over (partition by target) as tp, sum(neg) over (partition by target) as tn,
      coalesce(sum(pos) over (partition by target order by p rows between unbounded preceding and 1 preceding), 0) as bp,
      coalesce(sum(neg) over (partition by target order by p rows between unbounded preceding and 1 preceding), 0) as bn from sc""",
    "rk": "select target, sum(pos*(bn+neg/2))/nullif(max(tp)*max(tn),0) as AUC, sum(pos*(tp-bp)/(tp-bp+tn-bn))/nullif(max(tp),0) as average_precision from cum group by target",
}
add("d8_classification_metrics", lambda spark, sf: E.classification_metrics(
    t.predictions(spark, sf), ["target"], "experimental_tail_probability", "actual_tail_event", F.lit(t.FLAG_AT)), sql(f"""
  select target, avg((p-event)**2) as Brier, avg(event) as prevalence, sum(event)::bigint as events, sum(event*flag::int)::bigint as caught,
    sum(event*(1-flag::int))::bigint as missed, sum((1-event)*flag::int)::bigint as false_alerts, sum(flag::int)::bigint as alerts,
    {t.FLAG_AT}::double as alert_cutoff, coalesce(sum(event*flag::int)/nullif(sum(flag::int),0)::double, 0) as precision,
    coalesce(sum(event*flag::int)/nullif(sum(event),0)::double, 0) as recall, any_value(AUC) as AUC, any_value(average_precision) as average_precision
  from pred join rk using (target) group by target""", "Brier prevalence precision recall AUC average_precision alert_cutoff", extra=RANK))
add("d9_roc_auc", lambda spark, sf: R.ranking_metrics(t.predictions(spark, sf), ["target"], "experimental_tail_probability", "actual_tail_event").select("target", "AUC"),
    sql("""select target, (sum(r) filter (event=1) - count(*) filter (event=1)*(count(*) filter (event=1)+1)/2)/(count(*) filter (event=1)*count(*) filter (event=0)) as AUC from (
      select target, event, rank() over (partition by target order by p) + (count(*) over (partition by target, p)-1)/2::double as r from pred) group by target""", "AUC"))
add("d10_average_precision", lambda spark, sf: R.ranking_metrics(t.predictions(spark, sf), ["target"], "experimental_tail_probability", "actual_tail_event").select("target", "average_precision"),
    sql("select target, average_precision from rk", "average_precision", extra=RANK))
add("d11_tail_thresholds", lambda spark, sf: E.tail_thresholds(
    t.eligible_rows(spark, sf).filter(F.col("date") < F.lit(t.TRAIN_BEFORE).cast("date")), t.SPECS), sql("select * from thr", "lower upper"))
add("e18_recall_cutoff", lambda spark, sf: R.recall_cutoff(t.predictions(spark, sf), ["target"], "experimental_tail_probability", "actual_tail_event", 0.75),
    sql("select target, max(p) filter ((tp-bp)/tp >= 0.75) as cutoff from cum group by target", "cutoff", extra=RANK))
add("f1_largest_errors", lambda spark, sf: E.largest_errors(t.errors(spark, sf).withColumn("error", F.round("error", 6))).select("target", "site", "date", "error", "rank"), sql("""
  select target, site, date, error, cast(rank as int) as rank from (select target, site, date, round(error,6) as error,
    row_number() over (partition by target order by round(error,6) desc, site, date) as rank from err) where rank <= 10""", "error"))
add("f2_missed_events", lambda spark, sf: E.missed_events(t.errors(spark, sf)).select("target", "site", "date", "error"),
    sql("select target, site, date, error from err where event=1 and not flag", "error"))
add("f3_ranked_probabilities", lambda spark, sf: t.predictions(spark, sf).orderBy(F.desc("experimental_tail_probability"), "site", "target", "date").select(
    "site", "target", "date", "experimental_tail_probability"), sql("select site, target, date, p as experimental_tail_probability from pred", "experimental_tail_probability"))

# Bootstrap -------------------------------------------------------------------------------


def boot_sql(rows, keys, reps=1000):
    """The same hashed draws in SQL."""
    k = ", ".join(keys)
    on = " and ".join(f"d.{x}=s.{x}" for x in keys)
    dk = ", ".join(f"s.{x}" for x in keys)
    return {
        "site_gain": f"select {k}, site, sum(gain) as gain, count(*) as n from ({rows}) group by {k}, site",
        "slots": f"""select *, row_number() over (partition by {k} order by substr(md5(site),1,3), site) - 1 as slot,
          count(*) over (partition by {k}) as g from site_gain""",
        "bucket_draws": f"""select {k}, b*4+i as replicate, (cast('0x' || substr(md5('42:' || b || ':' || slot), 8*i+1, 8) as bigint) % g) // 1024 as bucket, count(*) as c
          from slots, (select unnest(range({-(-reps // 4)})) as b), (select unnest(range(4)) as i) where b*4+i < {reps} and g > 1024 group by all
          union all select {k}, unnest(range({reps})) as replicate, 0 as bucket, g as c from slots where g <= 1024 and slot = 0""",
        "blocks": f"select {k}, replicate, bucket, c, unnest(range((c+3)//4)) as blk from bucket_draws",
        "sizes": f"select {k}, slot // 1024 as bucket, count(*) as m from slots group by all",
        "draws": f"""select {k}, replicate, bucket*1024 + cast('0x' || substr(md5('42:' || replicate || ':' || bucket || ':' || blk), 8*i+1, 8) as bigint) % m as slot
          from blocks join sizes using ({k}, bucket), (select unnest(range(4)) as i) where blk*4+i < c""",
        "est": f"select {dk}, replicate, sum(gain)/sum(n) as e from draws d join slots s on {on} and d.slot=s.slot group by {dk}, replicate",
        "boot": f"""select {k}, sites, mean_gain, lower_95, upper_95 from
          (select {k}, count(*) as sites, sum(gain)/sum(n) as mean_gain from site_gain group by {k})
          join (select {k}, quantile_cont(e, 0.025) as lower_95, quantile_cont(e, 0.975) as upper_95 from est group by {k}) using ({k})""",
    }


GAIN = "select target, site, baseline_error - error as gain from err"
add("d21_cluster_bootstrap", lambda spark, sf: B.cluster_bootstrap(
    t.errors(spark, sf).select("target", "site", (F.col("baseline_error") - F.col("error")).alias("gain")), ["target"], "gain"),
    sql("select * from boot", "mean_gain lower_95 upper_95", extra=boot_sql(GAIN, ["target"])))
add("b20_evidence_status", lambda spark, sf: B.cluster_bootstrap(
    t.errors(spark, sf).select("target", "site", (F.col("baseline_error") - F.col("error")).alias("gain")), ["target"], "gain").select(
    "target", E.evidence_status(F.when(F.col("target") == "N", "site_median").otherwise("forest"), F.col("lower_95")).alias("status")),
    sql("select target, case when target='N' then 'baseline_selected' when lower_95 > 0 then 'positive_signal' else 'uncertain_signal' end as status from boot",
        extra=boot_sql(GAIN, ["target"])))


def b21(spark, sf):
    # Both uses below read one table.
    errors = staged(t.errors(spark, sf).select("target", "year", "site", (F.col("baseline_error") - F.col("error")).alias("gain")), "errors")
    counts = errors.groupBy("target", "year").agg(F.count(F.lit(1)).alias("n"))
    return B.cluster_bootstrap(errors, ["target", "year"], "gain", B.REPLICATES).join(counts, ["target", "year"]).select(
        "target", "year", "sites", "n", E.verdict(F.col("n"), F.col("sites"), F.col("mean_gain"), F.col("lower_95"), F.col("upper_95")).alias("verdict"))


add("b21_verdict", b21, sql("""
  select target, year, sites, n, case when n < 100 or sites < 10 then 'insufficient_data' when lower_95 > 0 then 'confirmed'
    when upper_95 <= 0 or mean_gain <= 0 then 'not_confirmed' else 'inconclusive' end as verdict
  from boot join (select target, year, count(*) as n from err group by all) using (target, year)""",
    extra=boot_sql("select target, year, site, baseline_error - error as gain from err", ["target", "year"], B.REPLICATES)))

# Folds -----------------------------------------------------------------------------------

FOLDS = {
    "yr": "select unnest([1999, 2000, 2001]) as y",
    "fold_r": """select elig.*, cast(y as varchar) as fold, case when date < make_date(y-2, 12, 22) then 'train'
      when date between make_date(y-1, 1, 1) and make_date(y-1, 12, 21) then 'validation'
      when date >= make_date(y, 1, 1) and (y = 2001 or date <= make_date(y, 12, 31)) then 'test' else 'embargo' end as split from elig, yr""",
    "sup": """select target, fold, count(*) filter (split='train') as train, count(*) filter (split='validation') as validation, count(*) filter (split='test') as test,
      count(distinct site) filter (split='test') as test_sites from fold_r where split<>'embargo' group by all""",
    "fmed": f"select target, fold, median({t.t_sql('actual')}) as median from fold_r where split='train' group by all",
    "fmed2": f"select target, fold, median({t.t_sql('actual')}) as median from fold_r where split in ('train','validation') group by all",
    "be_v": " union all ".join(
        f"""select target, fold, '{m}' as model, {i} as ord, avg(abs({t.t_sql('actual')} - {f})) as transformed_MAE, avg(abs(actual - {t.inv_sql(f)})) as source_MAE
        from fold_r join fmed using (target, fold) where split='validation' group by all"""
        for i, (m, f) in enumerate(zip(fixed.BASELINES, ["median", "last_value", "history_median", "seasonal_site"], strict=True))),
    "be_t": " union all ".join(
        f"""select target, fold, '{m}' as model, {i} as ord, avg(abs({t.t_sql('actual')} - {f})) as transformed_MAE, avg(abs(actual - {t.inv_sql(f)})) as source_MAE
        from fold_r join fmed2 using (target, fold) where split='test' group by all"""
        for i, (m, f) in enumerate(zip(fixed.BASELINES, ["median", "last_value", "history_median", "seasonal_site"], strict=True))),
    "sel": "select target, fold, arg_min(model, row(transformed_MAE, ord)) as selected from be_v group by all",
    "fthr": """select target, fold, case when target='N' then quantile_cont(actual,0.1) when target='R' then quantile_cont(actual,0.25) end as lower,
      case when target='N' then quantile_cont(actual,0.9) when target='A' then quantile_cont(actual,0.75) end as upper from fold_r where split='train' group by target, fold""",
    "gains": f"""select *, {t.t_sql('actual')} as y_, abs({t.t_sql('actual')} - last_value) - abs({t.t_sql('actual')} - forecast) as gain from (
      select fold_r.*, selected, case selected when 'global_median' then median when 'last_observation' then last_value when 'site_median' then history_median else seasonal_site end as forecast
      from fold_r join sel using (target, fold) join fmed2 using (target, fold) where split='test')""",
    "ev": f"""select target, fold, selected, 'last_observation' as selected_baseline, count(*) as test, avg(abs(y_-forecast)) as transformed_MAE,
      avg(abs(actual - {t.inv_sql('forecast')})) as source_MAE, avg(abs(y_-last_value)) as baseline_MAE from gains group by all""",
}
FOLDS_ALL = {**FOLDS, **boot_sql("select target, fold, site, gain from gains", ["target", "fold"], B.REPLICATES)}
FOLDS_ALL["evb"] = """select ev.*, sites, mean_gain, lower_95, upper_95, coalesce(100*(baseline_MAE-transformed_MAE)/nullif(baseline_MAE,0), 0) as improvement_percent,
  'baseline_selected' as status from ev join boot using (target, fold)"""
EV_DOUBLES = "transformed_MAE source_MAE baseline_MAE mean_gain lower_95 upper_95 improvement_percent"


def folded(spark, sf):
    # Rows are written once, not once per fold; a reader repeats the columns that it needs.
    return D.fold_rows(staged(t.eligible_rows(spark, sf), "rows"), t.FOLD_YEARS)


def validation(spark, sf):
    rows = folded(spark, sf)
    return D.baseline_errors(rows, D.fold_medians(rows, t.SPECS, ["train"]), "validation", t.SPECS)


def on_test(spark, sf):
    rows = folded(spark, sf)
    return D.baseline_errors(rows, D.fold_medians(rows, t.SPECS, ["train", "validation"]), "test", t.SPECS)


def evaluated(spark, sf):
    return D.baseline_evaluation(staged(t.eligible_rows(spark, sf), "rows"), t.SPECS, t.FOLD_YEARS, B.REPLICATES)


add("b23_chronological_split", lambda spark, sf: t.eligible_rows(spark, sf).select(
    "site", "target", "date", D.chronological_split(F.col("date"), 2001, final=True).alias("split")),
    sql("select site, target, date, split from fold_r where fold='2001'", extra=FOLDS))
add("i7_fold_support", lambda spark, sf: D.fold_support(folded(spark, sf)), sql(
    "select *, train>=150 and validation>=30 and test>=30 and test_sites>=5 as supported from sup", extra=FOLDS))
add("i9_baseline_validation", validation, sql(
    "select target, fold, model, cast(ord as int) as ord, transformed_MAE, source_MAE from be_v", "transformed_MAE source_MAE", extra=FOLDS))
add("i9_select_model", lambda spark, sf: D.select_model(validation(spark, sf)), sql("select * from sel", extra=FOLDS))
add("f4_arg_min_arg_max", lambda spark, sf: validation(spark, sf).groupBy("target", "fold").agg(
    F.min_by("model", F.struct("transformed_MAE", "ord")).alias("best"), F.max_by("model", F.struct("transformed_MAE", "ord")).alias("worst")),
    sql("select target, fold, arg_min(model, row(transformed_MAE, ord)) as best, arg_max(model, row(transformed_MAE, ord)) as worst from be_v group by all", extra=FOLDS))
add("i12_baseline_test", on_test, sql(
    "select target, fold, model, cast(ord as int) as ord, transformed_MAE, source_MAE from be_t", "transformed_MAE source_MAE", extra=FOLDS))
add("i12_evaluate_test", evaluated, sql("select * from evb", EV_DOUBLES, extra=FOLDS_ALL))


def i10(spark, sf):
    rows = folded(spark, sf)
    return D.class_counts(rows, D.fold_thresholds(rows, t.SPECS))


add("i10_class_counts", i10, sql("""
  select *, train_events/(train_events+train_others)::double as train_prevalence,
    (train_events+validation_events)/(train_events+train_others+validation_events+validation_others)::double as prevalence,
    least(train_events, train_others) >= 20 and least(validation_events, validation_others) >= 5 as classifier_allowed
  from (select target, fold, lower, upper, count(*) filter (split='train' and e) as train_events, count(*) filter (split='train' and not e) as train_others,
    count(*) filter (split='validation' and e) as validation_events, count(*) filter (split='validation' and not e) as validation_others
    from (select *, coalesce(actual<lower,false) or coalesce(actual>upper,false) as e from fold_r join fthr using (target, fold)) group by all)""",
    "lower upper train_prevalence prevalence", extra=FOLDS))
add("i19_adoption_rule", lambda spark, sf: D.adoption_rule(on_test(spark, sf), t.FOLD_YEARS, "site_seasonal", "site_median"), sql("""
  select target, count(*) as years, bool_and(c < r) as adopt from (select target, fold, max(transformed_MAE) filter (model='site_seasonal') as c,
    max(transformed_MAE) filter (model='site_median') as r from be_t group by all) group by target""", extra=FOLDS))


def d28(spark, sf):
    rows = staged(t.eligible_rows(spark, sf), "rows")
    folds = staged(D.fold_rows(rows, t.FOLD_YEARS), "folds")
    tested = D.baseline_errors(folds, D.fold_medians(folds, t.SPECS, ["train", "validation"]), "test", t.SPECS)
    return D.results_tables(tested, D.baseline_evaluation(rows, t.SPECS, t.FOLD_YEARS, B.REPLICATES))


add("d28_results_tables", d28, sql("""
  select evb.target, evb.fold, test, selected, evb.source_MAE, improvement_percent, strongest, 100*(1-transformed_MAE/least) as gain_over_strongest, status
  from evb join (select target, fold, arg_min(model, row(transformed_MAE, ord)) as strongest, min(transformed_MAE) as least from be_t group by all) using (target, fold)""",
    "source_MAE improvement_percent gain_over_strongest", extra=FOLDS_ALL))
add("d28_fold_pivot", lambda spark, sf: D.fold_pivot(evaluated(spark, sf), t.FOLD_YEARS), sql("""
  select target, max(improvement_percent) filter (fold='1999') as "1999", max(improvement_percent) filter (fold='2000') as "2000",
    max(improvement_percent) filter (fold='2001') as "2001" from evb group by target""", '"1999" "2000" "2001"', extra=FOLDS_ALL))


def d29(spark, sf):
    rows = staged(t.eligible_rows(spark, sf), "rows")
    support = D.fold_support(D.fold_rows(rows, t.FOLD_YEARS))
    return D.target_summary(spec_frame(spark, t.SPECS), support, D.baseline_evaluation(rows, t.SPECS, t.FOLD_YEARS, B.REPLICATES), "2001")


add("d29_target_summary", d29, sql("""
  select evb.target, case evb.target when 'A' then 'Flow A' when 'N' then 'Flow N' else 'Flow R' end as label, sup.train, sup.validation, sup.test,
    selected as selected_model, selected_baseline as baseline, transformed_MAE, source_MAE, baseline_MAE, sites, mean_gain, lower_95, upper_95, improvement_percent, status
  from evb join sup using (target, fold) where fold='2001'""", EV_DOUBLES, extra=FOLDS_ALL))
