"""Write-side, digest, retention and import-state queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import query
from checks.games import roster
from matchloom.functions.text import deck_fingerprint, truncate_text, uuid5
from matchloom.functions.times import (
    instant, lookback_start, next_weekly_boundary, same_local_day, weekly_boundary)
from matchloom.operators import digest as d
from matchloom.operators import keyed as k
from matchloom.operators import quality as q
from matchloom.plans import bindings as b
from matchloom.plans import imports as im
from matchloom.plans import periods
from matchloom.plans.bindings import table
from matchloom.plans.ratings import plan_prune


RELATIONS = [
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ("events_supplier", "events", "user_id", "supplier", "s_suppkey"),
]
VIEW_RELATIONS = [
    ("matches_rounds", "v_matches", "round_id", "v_rounds", "round_id"),
    ("matches_player1", "v_matches", "player1_id", "v_players", "player_id"),
    ("matches_winner", "v_matches", "winner_id", "v_players", "player_id"),
    ("registrations_sync", "v_registrations", "event_id", "v_sync", "event_id"),
]
VIEW_FRAMES = {"v_matches": b.matches, "v_rounds": b.rounds, "v_players": b.players,
               "v_registrations": b.registrations, "v_sync": b.event_sync_state}


@query("fk_violations", " union all ".join(
    f"select '{n}' as relation, count(*) as orphans from {c} c where c.{ck} is not null and not exists (select 1 from {p} p where p.{pk} = c.{ck})"
    for n, c, ck, p, pk in RELATIONS + VIEW_RELATIONS))
def fk_violations(spark, sf):
    def frame(name):
        return VIEW_FRAMES[name](spark, sf) if name in VIEW_FRAMES else table(spark, sf, name)
    return q.fk_violations([(n, frame(c), ck, frame(p), pk)
                            for n, c, ck, p, pk in RELATIONS + VIEW_RELATIONS])


def row_sql(columns):
    parts = [f"coalesce('=' || {c}::varchar, '~')" for c in sorted(columns)]
    return "sha256(" + " || chr(31) || ".join(parts) + ")"


def digest_sql(source, columns):
    lanes = ", ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 15))::bigint::hugeint) as s{i}" for i in range(d.LANES))
    text = " || ':' || ".join(["n::varchar"] + [f"coalesce(s{i}, 0)::varchar" for i in range(d.LANES)])
    return f"select n as row_count, sha256({text}) as digest from (select count(*) as n, {lanes} from (select {row_sql(columns)} as h from {source}))"


DIGESTED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"],
            "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]}


@query("table_digest", " union all ".join(f"select '{t}' as table_name, * from ({digest_sql(t, c)})" for t, c in DIGESTED.items()))
def table_digest(spark, sf):
    out = None
    for t, c in DIGESTED.items():
        row = d.table_digest(table(spark, sf, t), c).select(F.lit(t).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("reconcile_tables", f"""select * from (values ('lineitem', (select count(*) from lineitem), (select count(*) from lineitem), true, true),
 ('part', (select count(*) from part), (select count(*) from part where p_partkey % 100 <> 0), false, false)) t(table_name, source_rows, target_rows, digest_match, valid)""")
def reconcile_tables(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return d.reconcile({"lineitem": (line, line.repartition("l_partkey")),
                        "part": (part, part.filter(F.col("p_partkey") % 100 != 0))}, DIGESTED)


@query("snapshot_diff", """select coalesce(a.p_partkey, c.p_partkey) as p_partkey, case when a.p_partkey is null then 'new' when c.p_partkey is null then 'no_longer_listed' when a.p_partkey % 7 = 0 then 'changed' else 'unchanged' end as change
 from (select * from part where p_partkey % 10 <> 1) a full join (select * from part where p_partkey % 10 <> 2) c using (p_partkey)""")
def snapshot_diff(spark, sf):
    part = table(spark, sf, "part")
    old = part.filter(F.col("p_partkey") % 10 != 1).withColumn("h", F.sha2("p_name", 256))
    new = part.filter(F.col("p_partkey") % 10 != 2).withColumn("h", F.sha2(
        F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, "!").otherwise("")), 256))
    return k.diff_snapshots(old, new, ["p_partkey"], "h")


DISCOVERED = "select event_id as ord, case when event_id % 50 = 0 then null else event_id // 3 end as id, case when event_id % 40 = 1 then null else ts end as seen from events"


@query("window_dedup_counts", f"""with r as ({DISCOVERED}), f as (select *, min(case when seen >= timestamp '2024-01-05' and seen < timestamp '2024-01-20' then ord end) over (partition by id) as first from r)
 select case when id is null then 'missing_id' when seen is null then 'missing_datetime' when not (seen >= timestamp '2024-01-05' and seen < timestamp '2024-01-20') then 'boundary_excluded' when ord > first then 'duplicate' else 'selected' end as fate, count(*) as rows from f group by 1""")
def window_dedup_counts(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        e.alias("ord"), F.when(e % 50 != 0, F.expr("event_id div 3")).alias("id"),
        F.when(e % 40 != 1, F.col("ts")).alias("at"))
    fates = im.select_window_dedup(rows, "2024-01-05", "2024-01-20", "id", "at", "ord")
    return fates.groupBy("fate").agg(F.count(F.lit(1)).alias("rows"))


@query("merge_upsert", """with u as (select c_custkey as id, case when c_custkey % 4 = 0 then null else upper(c_name) end as name, case when c_custkey % 5 = 0 then null else c_nationkey + 100 end as nation, c_mktsegment || '2' as segment from customer where c_custkey % 2 = 0),
 t as (select c_custkey as id, c_name as name, c_nationkey as nation, case when c_custkey % 6 = 0 then null else c_mktsegment end as segment, c_custkey * 2 as untouched from customer where c_custkey % 3 = 0)
 select coalesce(t.id, u.id) as id, case when u.id is not null then u.name else t.name end as name, coalesce(u.nation, t.nation) as nation, coalesce(t.segment, u.segment) as segment, t.untouched from t full join u on t.id = u.id""")
def merge_upsert(spark, sf):
    c, i = table(spark, sf, "customer"), F.col("c_custkey")
    target = c.filter(i % 3 == 0).select(
        i.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.when(i % 6 != 0, F.col("c_mktsegment")).alias("segment"), (i * 2).alias("untouched"))
    updates = c.filter(i % 2 == 0).select(
        i.alias("id"), F.when(i % 4 != 0, F.upper("c_name")).alias("name"),
        F.when(i % 5 != 0, F.col("c_nationkey") + 100).alias("nation"),
        F.concat("c_mktsegment", F.lit("2")).alias("segment"), F.lit(2).alias("version"))
    older = updates.withColumn("name", F.lit("old")).withColumn("version", F.lit(1))
    return k.merge_upsert(target, updates.unionByName(older), ["id"],
                          {"name": "overwrite", "nation": "prefer_new", "segment": "keep_first"},
                          [F.col("version").desc()])


@query("insert_ignore", """select c_custkey as id, c_name as name from customer where c_custkey % 3 = 0 union all
 select o_custkey, 'first order ' || min(o_orderkey) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0) group by 1""")
def insert_ignore(spark, sf):
    target = table(spark, sf, "customer").filter(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("first order "), F.col("o_orderkey").cast("string")).alias("name"),
        "o_orderkey")
    return k.insert_ignore(target, updates, ["id"], [F.col("o_orderkey")])


SHA = """sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}')"""


@query("content_addressed", f"""select sha, p_brand, p_type, sha not in (select {SHA} from part where p_size < 10 and p_brand < 'Brand#2') as created from (select distinct {SHA} as sha, p_brand, p_type from part)""")
def content_addressed(spark, sf):
    part = table(spark, sf, "part")
    seen = part.filter((F.col("p_size") < 10) & (F.col("p_brand") < "Brand#2")).select(
        F.sha2(F.to_json(F.struct("p_brand", "p_type")), 256).alias("sha"))
    return k.content_addressed_append(
        seen, part.select("p_brand", "p_type"), ["p_type", "p_brand"])


@query("retention_slice", "select o_orderkey from orders where o_orderstatus <> 'O' and o_orderdate < timestamp '1996-01-01' order by o_orderdate, o_orderkey limit 100")
def retention_slice(spark, sf):
    return im.retention_slice(table(spark, sf, "orders"), "o_orderdate", "o_orderkey",
                              "1996-01-01", 100, F.col("o_orderstatus") != "O").select("o_orderkey")


@query("publication_prune", """select o_orderkey::varchar as run_id from orders where o_orderstatus <> 'P' and o_orderkey not in
 (select x from (select max(o_orderkey) as x from orders group by o_custkey union select min(o_orderkey) from orders group by o_custkey))""")
def publication_prune(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.when(
        F.col("o_orderstatus") == "P", "building").otherwise("validated").alias("status"))
    publications = o.groupBy("o_custkey").agg(
        F.max("o_orderkey").cast("string").alias("current_run"),
        F.min("o_orderkey").cast("string").alias("previous_run"))
    return plan_prune(runs, publications)


@query("ingest_window", "select distinct o_orderdate::date as day from orders where o_orderdate::date not in (select o_orderdate::date from orders where o_orderstatus = 'F' and o_totalprice > 300000)")
def ingest_window(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    log = o.filter(F.col("o_totalprice") > 300000).select("day", F.when(
        F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return im.pending_windows(o.select("day").distinct(), log)


KEY = """sha256('{"l_linestatus":"' || l_linestatus || '","l_partkey":' || l_partkey || '}')"""


@query("pending_by_key", f"""with q as (select distinct {KEY} as run_key, l_partkey, l_linestatus from lineitem), r as (select {KEY} as run_key, bool_or(l_quantity > 40) as done from lineitem where l_returnflag = 'R' group by 1)
 select run_key, l_partkey, l_linestatus, case when done then 'cached' when done is not null then 'restart' else 'new' end as decision from q left join r using (run_key)""")
def pending_by_key(spark, sf):
    line = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_linestatus"]
    runs = line.filter(F.col("l_returnflag") == "R").select(
        F.sha2(F.to_json(F.struct(*sorted(keys))), 256).alias("run_key"),
        F.when(F.col("l_quantity") > 40, "succeeded").otherwise("failed").alias("status"))
    return im.pending_by_key(line.select(*keys), runs, keys)


@query("pending_projection", "select replay_id, normalization_id from v_replays where normalization_status = 'valid' and projection_version is null")
def pending_projection(spark, sf):
    r = b.replays(spark, sf)
    models = r.filter(F.col("projection_version").isNotNull()).select(
        "normalization_id", F.col("projection_version").alias("version"))
    sources = r.filter(F.col("normalization_status") == "valid").select("replay_id", "normalization_id")
    return im.pending_projection(sources, models, "normalization_id", 1)


@query("stale_versions", "select replay_id, parser_version, projection_version from v_replays where parser_version <> 'parser_v1' or projection_version is distinct from 1")
def stale_versions(spark, sf):
    return im.stale_versions(b.replays(spark, sf), {
        "parser_version": "parser_v1", "projection_version": 1}).select(
        "replay_id", "parser_version", "projection_version")


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return q.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("import_outcomes", """select e.event_id, count(r.round_id) as expected, count(m.round_id) as imported, case when count(r.round_id) = 0 then 'no_results' when count(m.round_id) >= count(r.round_id) then 'complete' else 'partial' end as outcome
 from v_events e left join v_rounds r using (event_id) left join (select distinct round_id from v_matches) m on m.round_id = r.round_id group by 1""")
def import_outcomes(spark, sf):
    seen = b.matches(spark, sf).select("round_id").distinct().withColumn("_got", F.lit(1))
    rounds = b.rounds(spark, sf).select("event_id", "round_id").join(seen, "round_id", "left")
    per = b.events(spark, sf).select("event_id").join(rounds, "event_id", "left").groupBy(
        "event_id").agg(F.count("round_id").alias("expected"), F.count("_got").alias("imported"))
    return per.withColumn("outcome", q.import_outcome(F.col("expected"), F.col("imported")))


# --- import state and live events --------------------------------------------------------

NOW = dt.datetime(1998, 2, 1, 22)
STATE = "replace(replace(replace(upper(trim(coalesce({c}, ''))), '_', ''), '-', ''), ' ', '')"
STATES = [STATE.format(c=c) for c in im.STATUS_COLUMNS]
LISTED = lambda v: ", ".join(f"'{x}'" for x in v)
RUNS = "(" + " or ".join(f"{s} in ({LISTED(im.RUNNING)})" for s in STATES) + ") and " + " and ".join(
    f"{s} not in ({LISTED(im.FINISHED)})" for s in STATES)


@query("in_progress_events", f"select event_id, {RUNS} as in_progress from v_events")
def in_progress_events(spark, sf):
    return b.events(spark, sf).select("event_id", im.in_progress().alias("in_progress"))


@query("due_refresh", f"""select event_id, state, last_attempt_at from v_events join v_sync using (event_id) where event_id::varchar not in (select (o_orderkey % 2400)::varchar from orders where o_orderpriority = '1-URGENT' and o_orderkey % 7 = 0)
 and start_datetime >= timestamp '1998-02-01 22:00:00' - interval 120 day and start_datetime <= timestamp '1998-02-01 22:00:00'
 and (state in ({LISTED(im.RETRYABLE)}) or (state = 'complete' and coalesce(end_datetime, start_datetime) >= timestamp '1998-02-01 22:00:00' - interval 40 day and (({RUNS})
   or (end_datetime is not null and end_datetime + interval 2 hour <= timestamp '1998-02-01 22:00:00' and (last_attempt_at is null or last_attempt_at < end_datetime + interval 2 hour)))))
 and (last_attempt_at is null or last_attempt_at <= timestamp '1998-02-01 22:00:00' - interval 30 minute) order by last_attempt_at nulls first, start_datetime, event_id limit 25""")
def due_refresh(spark, sf):
    queued = table(spark, sf, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 7 == 0)).select(
        (F.col("o_orderkey") % 2400).cast("string").alias("resource_key"))
    return im.due_for_refresh(
        b.events(spark, sf), b.event_sync_state(spark, sf), queued, NOW, dt.timedelta(days=120),
        dt.timedelta(minutes=30), dt.timedelta(days=40), 25)


TEAM = """select slug, e.*, g.registration_status, g.registration_synced, r.preferred_display_name, r.member_id from v_events e join v_registrations g using (event_id) join v_links l using (player_id) join v_roster r on r.member_id = l.member_id"""
LIVE = f"""select distinct slug, event_id, name, source_url, timezone, start_datetime, preferred_display_name from ({TEAM}) where upper(trim(registration_status)) in ('ACTIVE', 'COMPLETE') and last_synced >= timestamp '1998-01-22' and registration_synced >= timestamp '1998-01-22'
 and start_datetime <= timestamp '1998-02-01 22:00:00' and end_datetime > timestamp '1998-01-20 00:00:00' and length(trim(source_url)) > 0 and {RUNS}"""


def team_rows(spark, sf):
    return im.team_events(b.events(spark, sf), b.registrations(spark, sf),
                          b.player_links(spark, sf), roster(spark, sf))


def live(spark, sf):
    """Started by NOW and not over on the 20th; the operator takes one instant for both."""
    rows = team_rows(spark, sf).withColumn("end_datetime", F.col("end_datetime") + F.expr(
        "interval 12 days 22 hours"))
    return im.eligible_live_events(rows, NOW, dt.datetime(1998, 1, 22))


@query("live_eligible", LIVE)
def live_eligible(spark, sf):
    return live(spark, sf)


@query("live_messages", f"""select slug, event_id, '**' || name || '**' || chr(10) || 'Playing: ' || string_agg(preferred_display_name, ', ' order by lower(preferred_display_name), preferred_display_name) || chr(10) || source_url as message
 from (select distinct slug, event_id, trim(name) as name, trim(source_url) as source_url, preferred_display_name from ({LIVE})) group by slug, event_id, name, source_url""")
def live_messages(spark, sf):
    return im.live_message(live(spark, sf))


ZONES = ["America/New_York", "UTC", "Asia/Tokyo"]


@query("local_day_current", """select event_id, case when timezone in ('America/New_York', 'UTC', 'Asia/Tokyo') and start_datetime is not null then
 (start_datetime + to_hours(case timezone when 'America/New_York' then -5 when 'Asia/Tokyo' then 9 else 0 end))::date = (timestamp '1998-02-02 03:00:00' + to_hours(case timezone when 'America/New_York' then -5 when 'Asia/Tokyo' then 9 else 0 end))::date else false end as current
 from v_events where start_datetime is null or (start_datetime >= timestamp '1998-01-01' and start_datetime < timestamp '1998-03-01')""")
def local_day_current(spark, sf):
    winter = F.col("start_datetime").isNull() | (
        (F.col("start_datetime") >= instant("1998-01-01")) & (F.col("start_datetime") < instant("1998-03-01")))
    return b.events(spark, sf).filter(winter).select("event_id", same_local_day(
        F.col("start_datetime"), F.col("timezone"), instant("1998-02-02 03:00:00"), ZONES).alias("current"))


@query("budget_fill", """with own as (select distinct event_id from v_events join v_registrations using (event_id) join v_links using (player_id) join v_roster using (member_id) where slug = 'nation_3' and start_datetime >= timestamp '1998-01-20' order by event_id limit 15),
 rest as (select event_id, row_number() over (order by last_attempt_at nulls first, event_id) as pos from v_events left join v_sync using (event_id) where start_datetime >= timestamp '1998-01-20' and event_id not in (select event_id from own))
 select event_id, tier, pos::int as pos from (select event_id, 0 as tier, row_number() over (order by event_id) as pos from own union all select event_id, 1, pos from rest) order by tier, pos limit 15""")
def budget_fill(spark, sf):
    since = F.col("start_datetime") >= instant("1998-01-20")
    own = team_rows(spark, sf).filter(since & (F.col("slug") == "nation_3"))
    rotation = b.events(spark, sf).filter(since).join(b.event_sync_state(spark, sf), "event_id", "left")
    return im.budget_fill(own, rotation, "event_id",
                          [F.col("last_attempt_at").asc_nulls_first(), F.col("event_id")], 15)


@query("location_search", """select event_id, name, s_name as store, n_name as country from v_events join supplier on s_suppkey = store_id join nation on n_nationkey = s_nationkey
 where lower(trim(n_name)) in ('nation_1', 'nation_2', 'nation_15') and lower(name) like '%event 1%'""")
def location_search(spark, sf):
    stores = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"),
        F.col("n_name").alias("country"))
    return periods.search_by_location(b.events(spark, sf), stores, "country",
                                      [" Nation_1", "NATION_2", "nation_15"], " EVENT 1")


SETS = """select nullif(p_brand, 'Brand#24') as name, case when p_brand = 'Brand#7' then 'promo' else substr(p_brand, 7) end as code,
 case when p_brand = 'Brand#13' then 'soon' else strftime(date '2023-01-01' + (substr(p_brand, 7)::int * 20)::int, '%Y-%m-%d') end as released_at from part group by p_brand"""


@query("current_period", f"""select name, code::int as code, released_at::timestamp as start from ({SETS}) where regexp_full_match(code, '[0-9]+') and code::int > 0 and name is not null and try_cast(released_at as date) <= date '2024-01-28'
 order by released_at desc, code::int desc, name desc limit 1""")
def current_period(spark, sf):
    brand = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    n = F.expr("cast(substring(brand, 7) as int)")
    sets = brand.select(
        F.when(F.col("brand") != "Brand#24", F.col("brand")).alias("name"),
        F.when(F.col("brand") == "Brand#7", "promo").otherwise(n.cast("string")).alias("code"),
        F.when(F.col("brand") == "Brand#13", "soon").otherwise(
            F.date_add(F.lit("2023-01-01").cast("date"), n * 20).cast("string")).alias("released_at"))
    return periods.current_period(sets, "2024-01-28")


@query("weekly_boundary", """select o_orderkey, b - case when dst_b then interval 4 hour else interval 5 hour end * -1 as boundary from (select *, (b >= (make_date(year(b), 4, 1) + ((7 - dayofweek(make_date(year(b), 4, 1))) % 7)::int)::timestamp + interval 2 hour
 and b < (make_date(year(b), 10, 31) - dayofweek(make_date(year(b), 10, 31))::int)::timestamp + interval 2 hour) as dst_b from (select o_orderkey, case when s > loc then s - interval 7 day else s end as b from
 (select *, (loc::date - dayofweek(loc)::int)::timestamp + interval 9 hour as s from (select o_orderkey, u - case when u >= (make_date(year(u), 4, 1) + ((7 - dayofweek(make_date(year(u), 4, 1))) % 7)::int)::timestamp + interval 7 hour
  and u < (make_date(year(u), 10, 31) - dayofweek(make_date(year(u), 10, 31))::int)::timestamp + interval 6 hour then interval 4 hour else interval 5 hour end as loc from (select o_orderkey, o_orderdate + to_hours((o_orderkey % 24)::int) as u from orders)))))""")
def weekly(spark, sf):
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", weekly_boundary(at).alias("boundary"))


@query("weekly_lengths", "select o_orderkey, true as whole_week, o_orderdate - interval 6 day as since from orders")
def weekly_lengths(spark, sf):
    """Following boundaries are 167, 168 or 169 hours apart; also the lookback start."""
    start = weekly_boundary(F.col("o_orderdate"))
    hours = (F.unix_micros(next_weekly_boundary(start).cast("timestamp"))
             - F.unix_micros(start.cast("timestamp"))) / 3_600_000_000
    return table(spark, sf, "orders").select(
        "o_orderkey", hours.isin(167.0, 168.0, 169.0).alias("whole_week"),
        lookback_start(F.col("o_orderdate"), 7).alias("since"))


@query("deck_fingerprint", """select conv_id, turn, sha256('[' || array_to_string(list_transform(list_sort(list_distinct(w)), lambda x: '[' || to_json(x)::varchar || ',' || len(list_filter(w, lambda y: y = x)) || ']'), ',') || ']') as deck_id
 from (select conv_id, turn, string_split_regex(trim(text), '\\s+') as w from conversations)""")
def deck_fingerprints(spark, sf):
    deck = F.split(F.trim("text"), r"\s+")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", deck_fingerprint(deck).alias("deck_id"))


@query("deterministic_ids", """select c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] as id
 from (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || c_name::blob) as h from customer)""")
def deterministic_ids(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("c_name")).alias("id"))


@query("truncated_text", "select item_id, case when length(text) > 60 then substr(text, 1, 57) || '...' else text end as short from benchmark")
def truncated_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", truncate_text(F.col("text"), 60).alias("short"))
