"""Sources, quarantine, collapse and audits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from creekline.functions import fixed_values as fixed
from creekline.functions import scalar as S
from creekline.functions.specs import default_specs, inverse, load_specs, spec_frame, transform
from creekline.operators import collapse as C
from creekline.operators import quarantine as Q
from creekline.session import scratch_dir
from creekline.sources import sinks, survey as SV, weather as WX
from verification import tables as t
from verification.registry import add
from verification.tables import sql

BOTH = "select * from judged_bacteria_ union all by name select * from judged_chemistry_"


def both(spark, sf):
    return t.survey(spark, sf, "bacteria").unionByName(t.survey(spark, sf, "chemistry"), allowMissingColumns=True)


def good(spark, sf, source):
    return Q.quarantine_rows(t.survey(spark, sf, source), t.SNAPSHOT)[0]


def csv_folder(spark, df, name):
    path = scratch_dir(spark, name)
    sinks.write_table(df, path, fmt="csv")
    return path


# A1, A2, A3 ------------------------------------------------------------------------------


def a1(spark, sf):
    raw = t.survey(spark, sf, "bacteria").drop("source", "csv_line").withColumn(
        "watershed", F.when(F.col("watershed") == "P", "N/A").otherwise(F.col("watershed"))
    )
    path = csv_folder(spark, raw, "a1")
    return SV.read_survey_csv(spark, path, columns=raw.columns).drop("_file")


add("a1_read_survey_csv", a1, sql(
    "select * exclude (source, csv_line) replace (case when watershed='P' then '' else watershed end as watershed) from raw_bacteria"
))


def a1_quoted(spark, sf):
    """One export file per month; notes hold quotes, line breaks and blank lines, so a record may take several lines."""
    raw = t.load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("globalid"), F.date_format("o_orderdate", "yyyyMM").alias("month"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("seen\n\nby \""), F.col("o_orderpriority"), F.lit("\",\nthen ")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("a \""), F.col("o_orderstatus"), F.lit("\", b"))).otherwise("none").alias("note"),
    )
    path = scratch_dir(spark, "a1-quoted")
    files = raw.repartition("month").sortWithinPartitions("month", "o_orderkey").drop("o_orderkey")
    sinks.write_table(files, path, partition_by=["month"], fmt="csv")
    return SV.read_survey_csv(spark, path, columns=["globalid", "note"], numbered=True).drop("_file")


add("a1_quoted_line_breaks", a1_quoted, sql("""select cast(o_orderkey as varchar) as globalid,
  case when o_orderkey % 3 = 0 then 'seen' || chr(10) || chr(10) || 'by "' || o_orderpriority || '",' || chr(10) || 'then '
       when o_orderkey % 3 = 1 then 'a "' || o_orderstatus || '", b' else 'none' end as note,
  row_number() over (partition by strftime(o_orderdate, '%Y%m') order by o_orderkey) + 1 as csv_line from orders"""))


def a2(spark, sf):
    """One export file per month of orders, each numbered on its own."""
    raw = t.load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("globalid"), F.date_format("o_orderdate", "yyyyMM").alias("month")
    )
    path = scratch_dir(spark, "a2")
    files = raw.repartition("month").sortWithinPartitions("month", "o_orderkey").drop("o_orderkey")
    sinks.write_table(files, path, partition_by=["month"], fmt="csv")
    return SV.with_source_line(SV.read_survey_csv(spark, path, columns=["globalid"], multiline=False)).drop("_file")


add("a2_with_source_line", a2, sql("""select cast(o_orderkey as varchar) as globalid,
  row_number() over (partition by strftime(o_orderdate, '%Y%m') order by o_orderkey) + 1 as csv_line from orders"""))


def a3(spark, sf):
    raw = t.survey(spark, sf, "bacteria")
    extras = Q.extra_columns(raw)
    return raw.select("csv_line", Q.has_overflow(extras).alias("overflow"), F.lit(",".join(extras)).alias("columns"))


add("a3_extra_columns", a3, sql("select csv_line, _c20 <> '' as overflow, '_c20' as columns from raw_bacteria"))


def a4(spark, sf):
    path = scratch_dir(spark, "a4")
    sinks.write_table(t.observations(spark, sf), path)
    return SV.read_observations(spark, path)


OBS = "select site, date, target, value, w[2] as waterbody, replicate_rows from obs"
add("a4_read_observations", a4, sql(OBS, "value"))


def json_file(spark, value, name):
    """One JSON file in the shared scratch folder."""
    path = scratch_dir(spark, name)
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)
    return path


def a5(spark, sf):
    """Specifications whose bounds come from the measurements, by way of a JSON file, and what is beyond them."""
    found = {r["target"]: r for r in t.measurements(spark, sf).groupBy("target").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    written = {
        s.target: {"source": s.source, "column": s.column, "label": s.label, "transform": s.transform, "direction": s.direction, "caution": s.caution,
                   "min": found[s.target]["low"] + 2, **({"max": found[s.target]["high"] - 10} if s.target != "R" else {})}
        for s in t.SPECS
    }
    specs = load_specs(spark, json_file(spark, written, "a5"))
    joined = t.measurements(spark, sf).join(spec_frame(spark, specs), "target")
    beyond = F.coalesce(F.col("value") > F.col("max"), F.lit(False)) | F.coalesce(F.col("value") < F.col("min"), F.lit(False))
    return joined.groupBy("target", "ord", "label", "transform", "direction", "caution", "min", "max").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(beyond).alias("beyond")
    )


add("a5_spec_dimension", a5, sql("""
  select s.target, s.ord, s.label, s.transform, s.direction, s.caution, min + 2 as min, case when s.target <> 'R' then max - 10 end as max, rows,
    (select count(*) from long x where x.target = s.target and (x.value < r.min + 2 or coalesce(s.target <> 'R' and x.value > r.max - 10, false))) as beyond
  from (values ('A',0,'Flow A','log1p','high',''), ('N',1,'Flow N','identity','both',''), ('R',2,'Flow R','identity','low','check units'))
    s(target, ord, label, transform, direction, caution)
  join (select target, count(*) as rows, cast(min(value) as double) as min, cast(max(value) as double) as max from long group by all) r using (target)"""))


def a6(spark, sf):
    stations = t.load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("STATION"), F.to_date("o_orderdate").cast("string").alias("DATE"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_totalprice").cast("string")).alias("PRCP"),
    )
    return WX.read_station_daily(spark, csv_folder(spark, stations, "a6"))


add("a6_read_station_daily", a6, sql(
    "select 'region' as series_id, cast(o_orderdate as date) as day, avg(case when o_orderstatus<>'P' then o_totalprice end) as rain "
    "from orders group by all", "rain"))


def a7(spark, sf):
    rows = t.flow(spark, sf).select(
        F.concat_ws("\t", F.lit("USGS"), F.lit(fixed.STREAM_GAUGE), F.col("day").cast("string"),
                    F.when(F.month("day") == 2, "Ice").otherwise(F.col("flow").cast("string")), F.lit("A")).alias("value")
    )
    head = spark.createDataFrame(
        [(0, "# provisional data"), (1, "agency_cd\tsite_no\tdatetime\t1_00060_00003\t1_00060_00003_cd"), (2, "5s\t15s\t20d\t14n\t10s")],
        "place int, value string",
    )
    path = scratch_dir(spark, "a7")
    # One gauge file: its head comes first.
    file = head.unionByName(rows.withColumn("place", F.lit(3))).repartitionByRange(1, "place")
    file.sortWithinPartitions("place", "value").select("value").write.text(path)
    return WX.read_gauge_rdb(spark, path)


add("a7_read_gauge_rdb", a7, sql(
    "select 'region' as series_id, day, case when month(day)<>2 then flow end as flow from flow_d", "flow"))

add("a8_calendar_spine", t.daily, sql("select * from daily_d", "rain flow"))


def a9(spark, sf):
    path = scratch_dir(spark, "a9")
    sinks.write_table(t.observations(spark, sf), path, partition_by=["target"], order=["target", "site", "date"])
    return spark.read.parquet(path).select("site", "date", F.col("target").cast("string").alias("target"), "value", "waterbody", "replicate_rows")


add("a9_write_table", a9, sql(OBS, "value"))


def a10(spark, sf):
    path = scratch_dir(spark, "a10")
    rows = t.measurements(spark, sf).groupBy("site", "target").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("value").alias("mean"),
        F.max(F.when(F.col("target") == "A", F.lit(float("inf"))).otherwise(F.col("value"))).alias("upper"),
    )
    sinks.write_metrics_json(rows, path)
    return spark.read.schema("site string, target string, rows bigint, mean double, upper double").json(path)


add("a10_write_metrics_json", a10, sql(
    "select site, target, count(*) as rows, avg(value) as mean, case when target<>'A' then max(value) end as upper from long group by site, target",
    "mean upper"))


def a11(spark, sf):
    """Every given table's files."""
    return sinks.fingerprint_inputs(spark, [f"{sf}/{n}.parquet" for n in TABLES]).select("file", "length", "sha256")


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]
add("a11_fingerprint_inputs", a11)


def a11_content(spark, sf):
    """Text files, one per month of orders, by both digests; nodes of 16 lines make trees of several levels."""
    raw = t.load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"), "o_orderstatus")
    path = scratch_dir(spark, "a11")
    lines = raw.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"))
    lines.write.partitionBy("month").text(path)
    whole = sinks.fingerprint_inputs(spark, [path])
    tree = sinks.tree_digests(spark, [path], 16)
    month = F.regexp_extract("path", "month=(\\d+)", 1)
    return whole.select(month.alias("month"), "length", "sha256").join(tree.select(month.alias("month"), "lines", "tree_sha256"), "month")


def a11_sql(levels=4, fan=16):
    """Nodes level by level; the month with most lines says how many levels there are, as in the tree of all files."""
    steps = {"al0": """select strftime(o_orderdate, '%Y%m') as month, o_orderkey || ',' || o_orderstatus as line,
        row_number() over (partition by strftime(o_orderdate, '%Y%m') order by o_orderkey) - 1 as pos from orders""",
             "an0": "select month, pos, sha256(line) as digest from al0"}
    for i in range(1, levels + 1):
        steps[f"an{i}"] = f"select month, pos // {fan} as pos, sha256(string_agg(digest, '' order by pos)) as digest from an{i - 1} group by month, pos // {fan}"
    pick = " union all ".join(
        f"select month, digest from an{i} where (select greatest(1, cast(ceil(ln(max(n)) / ln({fan}) - 1e-9) as int)) from an_size) = {i}" for i in range(1, levels + 1)
    )
    steps["an_size"] = "select count(*) as n from al0 group by month"
    steps["an_root"] = pick
    steps["an_file"] = "select month, count(*) as lines, sum(length(line) + 1) as length, sha256(string_agg(line || chr(10), '' order by pos)) as sha256 from al0 group by month"
    return sql("""select month, cast(length as bigint) as length, sha256, lines, sha256(cast(length as bigint) || ':' || digest) as tree_sha256
      from an_file join an_root using (month)""", extra=steps)


add("a11_file_digests", a11_content, a11_sql())


def a12(spark, sf):
    path = scratch_dir(spark, "a12") + "/model"
    t.measurements(spark, sf).groupBy("target").agg(F.avg("value").alias("mean")).write.parquet(path)
    digest = sinks.folder_digest(spark, path)
    sinks.assert_frozen(spark, path, digest)
    return spark.read.parquet(path).withColumn("frozen", F.lit(len(digest) == 64))


add("a12_assert_frozen", a12, sql("select target, avg(value) as mean, true as frozen from long group by all", "mean"))

# B: quarantine ---------------------------------------------------------------------------

JUDGED = "(select * from judged_bacteria union all by name select * from judged_chemistry)"

add("b1_quarantine_rows", lambda spark, sf: Q.quarantine_rows(both(spark, sf), t.SNAPSHOT)[1],
    sql(f"select source, csv_line, globalid, reason from {JUDGED} where reason <> ''"))


def b1_good(spark, sf):
    return Q.quarantine_rows(both(spark, sf), t.SNAPSHOT)[0].select("source", "csv_line", "site", "date", "waterbody")


add("b1_good_rows", b1_good, sql(f"select source, csv_line, site, date, waterbody from {JUDGED} where reason = ''"))


def b2(spark, sf):
    parts = []
    for source in ("bacteria", "chemistry"):
        raw = t.survey(spark, sf, source)
        parts.append(Q.quarantine_rows(raw, t.SNAPSHOT, Q.v1_row_rules(raw, t.SNAPSHOT, source))[1])
    return parts[0].unionByName(parts[1])


add("b2_v1_quarantine", b2, sql(
    "select source, csv_line, globalid, reason from (select * from v1judged_bacteria union all by name select * from v1judged_chemistry) where reason <> ''"))


def rule(name):
    def build(spark, sf):
        raw = t.survey(spark, sf, "bacteria")
        return raw.select("csv_line", Q.row_rules(raw, t.SNAPSHOT)[name].alias("hit"))
    return build


for number, name in enumerate(
    ["nonempty_extra_columns", "invalid_site_identifier", "invalid_or_shifted_metadata", "invalid_date", "sample_after_snapshot"]
):
    add(f"b{number + 3}_{name}", rule(name), sql(f"select csv_line, contains(reason, '{name};') as hit from judged_bacteria"))


def cells(spark, sf, source):
    return Q.wide_to_long(good(spark, sf, source), default_specs(), source)


def b8(spark, sf):
    parts = [Q.quarantine_cells(cells(spark, sf, s), default_specs())[1] for s in ("bacteria", "chemistry")]
    return parts[0].unionByName(parts[1])


CELLS = "(select * from cells_bacteria union all by name select * from cells_chemistry)"
add("b8_quarantine_cells", b8, sql(
    f"select source, csv_line, target, text as value, 'non_numeric_or_outside_configured_range' as reason from {CELLS} where bad"))


def b8_valid(spark, sf):
    parts = [Q.quarantine_cells(cells(spark, sf, s), default_specs())[0] for s in ("bacteria", "chemistry")]
    return parts[0].unionByName(parts[1])


add("b8_valid_cells", b8_valid, sql(
    f"select source, csv_line, site, date, target, value, waterbody from {CELLS} where text <> '' and not bad", "value"))
add("b9_wide_to_long", lambda spark, sf: cells(spark, sf, "chemistry"),
    sql("select source, csv_line, site, date, waterbody, target, text from cells_chemistry"))


def b10(spark, sf):
    return Q.v1_measurements(good(spark, sf, "chemistry"), "chemistry")


add("b10_null_if_outside", b10, sql(
    "select csv_line, site, date, " + ", ".join(
        f"case when {t.sql_number(c)} between {lo} and {hi} then {t.sql_number(c)} end as {c}"
        for c, (lo, hi) in fixed.V1_CHEMISTRY.items()
    ) + ", watershed, waterbody from good_chemistry", " ".join(fixed.V1_CHEMISTRY)))

# Scalar groups ---------------------------------------------------------------------------


def scalars(spark, sf):
    rows = t.measurements(spark, sf)
    target, value = F.col("target"), F.col("value")
    moved = transform(t.SPECS, target, value)
    return rows.select(
        "csv_line", "target", "date", "value",
        moved.alias("moved"), inverse(t.SPECS, target, moved).alias("back"),
        inverse(t.SPECS, target, moved * 2).alias("clipped"),
        S.season(F.col("date")).alias("season"),
        S.history_age_bucket(F.col("value") * 3).alias("age_bucket"),
        F.sin(S.month_angle(F.col("date"))).alias("month_sin"),
        F.date_sub("date", 7).alias("issue_date"),
    )


BUCKET = "case when {0}>0 and {0}<=35 then '10–35 days' when {0}>35 and {0}<=60 then '36–60 days' when {0}>60 and {0}<=120 then '61–120 days' end"
SEASON = ("case when month(date) in (12,1,2) then 'winter' when month(date) in (3,4,5) then 'spring' "
          "when month(date) in (6,7,8) then 'summer' else 'autumn' end")
add("s_transform_inverse_dates", scalars, sql(f"""
  select csv_line, target, date, value, {t.t_sql('value')} as moved, {t.inv_sql(t.t_sql('value'))} as back,
    {t.inv_sql('(2*' + t.t_sql('value') + ')')} as clipped, {SEASON} as season, {BUCKET.format('(value*3)')} as age_bucket,
    sin(2*pi()*month(date)/12) as month_sin, cast(date - interval 7 day as date) as issue_date
  from long""", "value moved back clipped month_sin"))


def numbers(spark, sf):
    return t.survey(spark, sf, "bacteria").select(
        "csv_line", S.to_number(F.col("Average_e_coli")).alias("number"),
        S.to_sample_date(F.col("sample_date_time")).alias("date"),
        S.text_key(F.col("Site_Location")).alias("key"),
        F.sha2("globalid", 256).alias("digest"),
    )


add("s_text_number_date_key", numbers, sql(f"""
  select csv_line, {t.sql_number('Average_e_coli')} as number, cast({t.sql_time('sample_date_time')} as date) as date,
    regexp_replace(lower(Site_Location), '[^a-z0-9]', '', 'g') as key, sha256(globalid) as digest from raw_bacteria""", "number"))

# D1-D4, D30 ------------------------------------------------------------------------------

add("d1_collapse_replicates", t.observations, sql(OBS, "value"))
add("d1_collapse_hot_groups", lambda spark, sf: C.collapse_replicates(
    t.measurements(spark, sf).withColumn("site", F.lit("all"))),
    sql("""select 'all' as site, date, target, median(value) as value, min(row(csv_line, waterbody))[2] as waterbody,
      count(*) as replicate_rows from long group by date, target""", "value"))


def d2(spark, sf):
    raw = t.survey(spark, sf, "chemistry")
    kept = Q.quarantine_rows(raw, t.SNAPSHOT, Q.v1_row_rules(raw, t.SNAPSHOT, "chemistry"))[0]
    return C.v1_collapse_site_days(Q.v1_measurements(kept, "chemistry"), C.V1_NUMERIC["chemistry"])


add("d2_v1_collapse_site_days", d2, sql(
    "select site, date, " + ", ".join(
        f"median(case when {t.sql_number(c)} between {lo} and {hi} then {t.sql_number(c)} end) as {c}"
        for c, (lo, hi) in fixed.V1_CHEMISTRY.items()
    ) + ", min(row(csv_line, watershed, waterbody))[2] as watershed, min(row(csv_line, watershed, waterbody))[3] as waterbody,"
    " count(*) as rows from good_chemistry group by site, date", " ".join(fixed.V1_CHEMISTRY)))

add("d3_ingest_audit", lambda spark, sf: Q.ingest_audit(both(spark, sf), t.SNAPSHOT), sql(f"""
  select source, count(*) as input_rows, count(*) filter (reason <> '') as structurally_excluded_rows,
    count(*) filter (reason = '') as retained_rows from {JUDGED} group by source"""))


def d3_v1(spark, sf):
    raw = t.survey(spark, sf, "bacteria")
    rules = Q.v1_row_rules(raw, t.SNAPSHOT, "bacteria")
    kept = Q.quarantine_rows(raw, t.SNAPSHOT, rules)[0]
    days = C.v1_collapse_site_days(Q.v1_measurements(kept, "bacteria"), C.V1_NUMERIC["bacteria"])
    return C.v1_ingest_audit(Q.with_reason(raw, rules), days)


add("d3_v1_ingest_audit", d3_v1, sql("""
  with g as (select * from v1judged_bacteria where reason = '')
  select (select count(*) from v1judged_bacteria) as input_rows, (select count(*) from v1judged_bacteria where reason<>'') as excluded_rows,
    (select count(*) from g) as retained_rows, (select count(*) from (select distinct site, date from g)) as site_days,
    (select count(*) from g) - (select count(*) from (select distinct site, date from g)) as duplicate_site_days_collapsed,
    (select count(distinct site) from g) as sites, (select min(date) from g) as date_min, (select max(date) from g) as date_max"""))


def d4(spark, sf):
    from creekline.operators.history import training_rows
    obs = sinks.staged(t.observations(spark, sf), "obs")
    return Q.target_coverage(obs, training_rows(obs, t.SPECS, cross=False), spec_frame(spark, t.SPECS)).drop("source_column", "caution", "label")


add("d4_target_coverage", d4, sql("""
  select target, count(*) as valid_site_days, count(distinct site) as sites, min(date) as first_date, max(date) as last_date,
    (select count(*) from elig e where e.target = o.target) as eligible_forecasts from obs o group by target"""))

# F5, G -----------------------------------------------------------------------------------

add("f5_canonical_order", lambda spark, sf: t.observations(spark, sf).repartitionByRange("site", "target", "date").sortWithinPartitions("site", "target", "date")
    .select("site", "date", "target", "value"), sql("select site, date, target, value from obs", "value"))
add("g1_union_tables", b8, sql(
    f"select source, csv_line, target, text as value, 'non_numeric_or_outside_configured_range' as reason from {CELLS} where bad"))
