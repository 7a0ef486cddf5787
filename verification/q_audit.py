"""Source checks, identities, sensitivity and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions.specs import default_specs
from creekline.operators import checks as K
from creekline.operators import revisions as V
from creekline.operators import sensitivity as N
from creekline.operators.bootstrap import REPLICATES, cluster_bootstrap
from creekline.operators.collapse import collapse_replicates
from creekline.operators.history import training_rows
from creekline.sources.sinks import staged
from verification import tables as t
from verification.q_errors import SUM_DOUBLES, boot_sql, summary_sql
from verification.q_ingest import good
from verification.registry import add
from verification.tables import sql

# D12, D13, D16-D19 -----------------------------------------------------------------------

add("d12_profile_measurements", lambda spark, sf: K.profile_measurements(good(spark, sf, "bacteria"), default_specs(), "bacteria").unionByName(
    K.profile_measurements(good(spark, sf, "chemistry"), default_specs(), "chemistry")), sql("""
  select target, rows as structurally_valid_rows, numeric_values, rows - numeric_values as missing_or_nonnumeric, minimum, maximum, zero_values,
    most_common_value, coalesce(most_common_count, 0) as most_common_count
  from (select target, count(*) as rows, count(value) as numeric_values, min(value) as minimum, max(value) as maximum, count(*) filter (value=0) as zero_values
    from (select * from cells_bacteria union all by name select * from cells_chemistry) group by target)
  left join (select target, arg_min(value, row(-n, value)) as most_common_value, max(n) as most_common_count from
    (select target, value, count(*) as n from (select * from cells_bacteria union all by name select * from cells_chemistry) where value is not null group by all) group by target) using (target)""",
    "minimum maximum most_common_value"))


def d13(spark, sf):
    rows = good(spark, sf, "chemistry").withColumn(
        "Review_PH", F.when(F.col("watershed") == "F", F.lit("7")).otherwise(F.col("ph_standard_units"))
    ).withColumn("Review_conductivity", F.when(F.col("waterbody") == "2-HIGH", F.lit("unknown")).otherwise(F.concat(F.col("conductivity"), F.lit(".02"))))
    return K.reviewed_vs_original(rows, default_specs())


add("d13_reviewed_vs_original", d13, sql(f"""
  select source, csv_line, target, original, reviewed from (
    select source, csv_line, 'ph' as target, {t.sql_number('ph_standard_units')} as original,
      {t.sql_number("(case when watershed='F' then '7' else ph_standard_units end)")} as reviewed from good_chemistry
    union all select source, csv_line, 'conductivity', {t.sql_number('conductivity')},
      {t.sql_number("(case when waterbody='2-HIGH' then 'unknown' else conductivity || '.02' end)")} from good_chemistry)
  where original is not null and reviewed is not null and not abs(original-reviewed) <= 0.01::double + 0.0001::double*abs(reviewed)""", "original reviewed"))
add("d16_method_crosstab", lambda spark, sf: K.method_crosstab(good(spark, sf, "chemistry")).withColumn("method", K.label_default(F.col("method"))), sql(f"""
  select case when turbidity_tube_or_meter='' then '(no method recorded)' else turbidity_tube_or_meter end as method, count(*) as rows,
    count({t.sql_number('Turbidity')}) as numeric_values, count(*) filter ({t.sql_number('Turbidity')}=8) as value_equal_8 from good_chemistry group by 1"""))
add("b26_label_default", lambda spark, sf: good(spark, sf, "chemistry").select("csv_line", K.label_default(F.col("turbidity_tube_or_meter")).alias("method")), sql(
    "select csv_line, coalesce(nullif(turbidity_tube_or_meter,''), '(no method recorded)') as method from good_chemistry"))
def stamped(spark, sf):
    parts = [good(spark, sf, s).select("source", "sample_date_time", "CreationDate") for s in ("bacteria", "chemistry")]
    return parts[0].unionByName(parts[1])


add("d17_timing_audit", lambda spark, sf: K.timing_audit(stamped(spark, sf)), sql(f"""
  select source, count(*) as rows, count(*) filter (hour(s)=0 and minute(s)=0) as midnight_sample_timestamps, count(distinct cast(c as date)) as creation_dates,
    median((epoch_us(c)-epoch_us(s))/86400000000::double) as median_creation_lag_days
  from (select source, {t.sql_time('sample_date_time')} as s, {t.sql_time('CreationDate')} as c from good_bacteria
    union all select source, {t.sql_time('sample_date_time')}, {t.sql_time('CreationDate')} from good_chemistry) group by source""", "median_creation_lag_days"))


def all_raw(spark, sf):
    parts = [good(spark, sf, s).select("source", "csv_line", "site", "date", "waterbody", "Site_Location") for s in ("bacteria", "chemistry")]
    return parts[0].unionByName(parts[1])


KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
RAW = {"allraw": "select source, csv_line, site, date, waterbody, Site_Location from good_bacteria union all select source, csv_line, site, date, waterbody, Site_Location from good_chemistry",
       "ident": f"""select site, count(*) as rows, count(distinct {KEY.format('waterbody')}) as waterbody_variants,
    count(distinct nullif({KEY.format('Site_Location')}, '')) as location_variants, min(date) as first_date, max(date) as last_date,
    (select string_agg(w, '; ' order by w) from (select distinct waterbody as w from allraw b where b.site=a.site)) as waterbodies from allraw a group by site"""}
add("d18_site_identity_audit", lambda spark, sf: K.site_identity_audit(all_raw(spark, sf)), sql("select * from ident", extra=RAW))
add("b25_site_conflicts", lambda spark, sf: K.site_conflicts(K.site_identity_audit(all_raw(spark, sf))), sql("""
  select site, rows, first_date, last_date, array_to_string(list_filter(string_split(waterbodies, '; '), lambda x: trim(x) <> ''), '; ') as waterbodies,
    '' as same_physical_site, '' as authoritative_name, '' as notes from ident where waterbody_variants > 1""", extra=RAW))
add("d19_candidate_aliases", lambda spark, sf: K.candidate_aliases(all_raw(spark, sf)), sql(f"""
  select min(row(source, csv_line, waterbody))[3] as waterbody, string_agg(distinct site, ';' order by site) as site_codes, count(distinct site) as site_count,
    count(*) as rows, '{fixed.ALIAS_NOTE}' as note from allraw where {KEY.format('Site_Location')} <> ''
  group by {KEY.format('waterbody')}, {KEY.format('Site_Location')} having count(distinct site) > 1""", extra=RAW))

# D14, D15, B11, B12, D27, B24 ------------------------------------------------------------


def check_rows(spark, sf):
    """lineitem as replicate counts: the reported average is right, rounded, floored or wrong."""
    li = t.load(spark, sf, "lineitem")
    expected = F.col("l_discount") * F.col("l_quantity")
    reported = F.when(expected == 0, 1.0).when(F.col("l_tax") > 0.07, F.round(expected) + 3).otherwise(F.round(expected))
    text = [F.col("l_quantity").cast("string").alias(f"q{i}") for i in (1, 2, 3)]
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("csv_line"), *text,
        F.when(F.col("l_discount") == 0, F.lit("1e9")).otherwise((F.lit(100.0) / F.col("l_discount")).cast("string")).alias("sample_volume"),
        reported.cast("string").alias("reported"),
        F.col("l_linestatus"),
    )


def count_checks(spark, sf):
    return K.count_volume_check(check_rows(spark, sf), {"A": "reported"}, {"A": ["q1", "q2", "q3"]})


CHECK = {
    "chk": """select l_orderkey*8+l_linenumber as csv_line, l_quantity as q, case when l_discount=0 then 1e9 else 100::double/l_discount end as vol,
      case when l_discount*l_quantity=0 then 1 when l_tax>0.07 then round(l_discount*l_quantity)+3 else round(l_discount*l_quantity) end as reported from lineitem""",
    "cv": """select *, abs(reported-expected) <= 0.02::double + 0.001::double*abs(expected) as match from (select csv_line, 'A' as target, reported, (q+q+q)/3*100/vol as expected from chk)""",
    "cvt": """select csv_line, target, reported, expected as candidate_count_volume_formula, match as matches_candidate_formula,
      case when match then 'match' when abs(reported-expected) <= 0.5 then 'within_half_unit_rounding' when reported=1 and expected=0 then 'possible_zero_floor_to_one'
      else 'requires_protocol_review' end as discrepancy_type from cv""",
    "dv": """select csv_line, target, reported, f as candidate_formula, abs(reported-f) <= 0.05::double + 0.001::double*abs(f) as matches_candidate_formula from (
      select csv_line, 'A' as target, reported, (q+q)/2*1 as f from chk union all select csv_line, 'N', reported, q*5 from chk)""",
}
CHECK_DOUBLES = "reported candidate_count_volume_formula"
add("d14_count_volume_check", count_checks, sql("select * from cvt", CHECK_DOUBLES, extra=CHECK))
add("b12_discrepancy_type", lambda spark, sf: count_checks(spark, sf).groupBy("discrepancy_type").agg(F.count(F.lit(1)).alias("rows")),
    sql("select discrepancy_type, count(*) as rows from cvt group by all", extra=CHECK))
add("d27_discrepancy_counts", lambda spark, sf: K.discrepancy_counts(count_checks(spark, sf)),
    sql("select target, discrepancy_type, count(*) as rows from cvt group by all", extra=CHECK))


def derived_checks(spark, sf):
    return K.derived_value_check(check_rows(spark, sf), {"A": "reported", "N": "reported"}, {"A": (["q1", "q2"], 1), "N": (["q3"], 5)})


add("d15_derived_value_check", derived_checks, sql("select * from dv", "reported candidate_formula", extra=CHECK))
add("b24_review_rows", lambda spark, sf: K.review_rows(count_checks(spark, sf), "export.csv"), sql("""
  select 'export.csv' as source_file, csv_line, target, reported, candidate_count_volume_formula, discrepancy_type, '' as correct_value, '' as notes
  from cvt where discrepancy_type <> 'match'""", CHECK_DOUBLES, extra=CHECK))
add("b24_review_rows_derived", lambda spark, sf: K.review_rows(derived_checks(spark, sf), "export.csv"), sql("""
  select 'export.csv' as source_file, csv_line, target, reported, candidate_formula, '' as correct_value, '' as notes
  from dv where not matches_candidate_formula""", "reported candidate_formula", extra=CHECK))

# C7, C10, G2, D20: sensitivity -----------------------------------------------------------


def lines(spark, sf):
    """Source lines: one per order, with a site and a date."""
    return t.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").cast("string").alias("site"), F.to_date(F.min("l_shipdate")).alias("date")
    ).withColumnRenamed("l_orderkey", "csv_line")


def line_checks(spark, sf):
    return t.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("csv_line"), F.col("l_returnflag").alias("target"), "l_tax", "l_linestatus", "l_discount"
    )


FLAG = {
    "src": "select l_orderkey as csv_line, cast(min(l_suppkey) as varchar) as site, cast(min(l_shipdate) as date) as date from lineitem group by l_orderkey",
    "ck": "select distinct site, date, l_returnflag as target from lineitem join src on l_orderkey=csv_line where l_tax > 0.07",
    "ck2": "select distinct site, date, l_returnflag as target from lineitem join src on l_orderkey=csv_line where l_tax > 0.05",
    "ck3": "select distinct site, date, l_returnflag as target from lineitem join src on l_orderkey=csv_line",
    "amb": "select cast(s_suppkey as varchar) as site from supplier where s_acctbal < 1000",
    "unk": "select distinct cast(l_suppkey as varchar) as site, cast(l_shipdate as date) as date from lineitem where l_discount > 0.05",
    "fl": """select err.*, amb.site is not null as ambiguous_site_label, ck.site is not null as formula_protocol_review, ck2.site is not null as any_formula_difference,
      err.target='N' and unk.site is not null as reported_turbidity_nonmeter_or_missing_method, ck3.site is not null as formula_checked
      from err left join amb on amb.site=err.site left join ck on ck.site=err.site and ck.date=err.date and ck.target=err.target
      left join ck2 on ck2.site=err.site and ck2.date=err.date and ck2.target=err.target left join unk on unk.site=err.site and unk.date=err.date
      left join ck3 on ck3.site=err.site and ck3.date=err.date and ck3.target=err.target""",
}
SCENARIOS = {
    "all_test_observations": "true", "exclude_ambiguous_site_labels": "not ambiguous_site_label",
    "exclude_protocol_formula_flags": "not formula_protocol_review", "exclude_any_formula_difference": "not any_formula_difference",
    "reported_turbidity_meter_only": "not reported_turbidity_nonmeter_or_missing_method",
    "combined_conservative_subset": "not (ambiguous_site_label or any_formula_difference or reported_turbidity_nonmeter_or_missing_method)",
}


def keys_where(spark, sf, condition):
    return N.join_many_to_one(line_checks(spark, sf).filter(condition), lines(spark, sf))


def flagged(spark, sf):
    suppliers = t.load(spark, sf, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").cast("string").alias("site"))
    unknown = t.load(spark, sf, "lineitem").filter("l_discount > 0.05").select(
        F.col("l_suppkey").cast("string").alias("site"), F.to_date("l_shipdate").alias("date"))
    return N.observation_flags(
        t.errors(spark, sf), suppliers, keys_where(spark, sf, "l_tax > 0.07"), keys_where(spark, sf, "l_tax > 0.05"),
        unknown, keys_where(spark, sf, "true"), method_target="N")


add("c7_join_many_to_one", lambda spark, sf: keys_where(spark, sf, "l_tax > 0.07"), sql("select * from ck", extra=FLAG))
add("g2_union_keys", lambda spark, sf: N.union_keys(keys_where(spark, sf, "l_tax > 0.07"), keys_where(spark, sf, "l_discount > 0.05")), sql("""
  select * from ck union select site, date, l_returnflag as target from lineitem join src on l_orderkey=csv_line where l_discount > 0.05""", extra=FLAG))
add("c10_flag_membership", lambda spark, sf: flagged(spark, sf).select("site", "date", "target", *N.FLAGS),
    sql("select site, date, target, " + ", ".join(N.FLAGS) + " from fl", extra=FLAG))
add("d20_sensitivity_scenarios", lambda spark, sf: N.sensitivity_scenarios(staged(flagged(spark, sf), "flagged")), sql(
    "select * from (" + " union all by name ".join(
        f"(select '{name}' as scenario, *, original_samples - samples as excluded_samples from ({summary_sql('target', 'fl', where)}) "
        f"join (select target, count(*) as original_samples from fl group by target) using (target))" for name, where in SCENARIOS.items()) + ")",
    SUM_DOUBLES, extra=FLAG))


def gains(spark, sf):
    return cluster_bootstrap(staged(N.scenario_gains(flagged(spark, sf)), "gains"), ["target", "scenario"], "gain", REPLICATES)


add("d21_scenario_bootstrap", gains, sql("select * from boot", "mean_gain lower_95 upper_95", extra={**FLAG, **boot_sql(
    " union all ".join(f"select target, '{n}' as scenario, site, baseline_error-error as gain from fl where {SCENARIOS[n]}"
                       for n in ("all_test_observations", "combined_conservative_subset")), ["target", "scenario"], REPLICATES)}))

# C6, C8, C9, C12, G3, G4 -----------------------------------------------------------------


def old_and_new(spark, sf):
    """The same aggregates before and after a source revision driven by line status."""
    rows = t.measurements(spark, sf)
    old = collapse_replicates(rows.filter("waterbody = 'F' or value > 5"), names=False)
    new = collapse_replicates(rows.filter("waterbody = 'O' or value < 45"), names=False)
    return old, new


REV = {"old_t": "select site, date, target, median(value) as value from long where waterbody='F' or value > 5 group by all",
       "new_t": "select site, date, target, median(value) as value from long where waterbody='O' or value < 45 group by all"}
add("c8_revisions", lambda spark, sf: V.revisions(*old_and_new(spark, sf), "2001-12-31"), sql("""
  select count(*) filter (a.value is not null and b.value is not null and abs(a.value-b.value) <= 1e-8 + 1e-5*abs(b.value)) as unchanged,
    count(*) filter (a.value is not null and b.value is not null and not abs(a.value-b.value) <= 1e-8 + 1e-5*abs(b.value)) as changed,
    count(*) filter (b.value is null) as removed, count(*) filter (a.value is null) as added
  from old_t a full join new_t b on a.site=b.site and a.date=b.date and a.target=b.target""", extra=REV))
add("c9_overlay", lambda spark, sf: V.overlay(*[x.select("site", "date", "target", "value") for x in old_and_new(spark, sf)]), sql(
    "select * from new_t union all select * from old_t where not exists (select 1 from new_t b where b.site=old_t.site and b.date=old_t.date and b.target=old_t.target)", "value", extra=REV))


def g3(spark, sf):
    old, new = old_and_new(spark, sf)
    return old.select("site", "date", "target").exceptAll(new.select("site", "date", "target"))


add("g3_anti_join", g3, sql(
    "select site, date, target from old_t except select site, date, target from new_t", extra=REV))
add("g4_distinct", lambda spark, sf: t.measurements(spark, sf).select("site", "target").distinct(), sql("select distinct site, target from long"))


def c6(spark, sf):
    obs = staged(t.observations(spark, sf), "obs")
    checked = V.verify_join_1_1(t.predictions_from(training_rows(obs, t.SPECS, cross=False)), obs)
    return checked.select("site", "date", "target", "actual", "value")


add("c6_verify_join_1_1", c6, sql(
    "select site, date, target, actual, value from pred join obs using (site, date, target)", "actual value"))
add("c12_exclude_sites", lambda spark, sf: V.exclude_sites(t.observations(spark, sf), ["3", "7", "11"]).select("site", "date", "target", "value"),
    sql("select site, date, target, value from obs where site not in ('3','7','11')", "value"))
