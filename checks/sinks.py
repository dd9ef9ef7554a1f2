"""Writes: merges that tell their changes, read models, logs, snapshots; checks on findings, bundles and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.ratings import published
from matchloom.functions.text import id_name_pairs, request_allowed
from matchloom.operators.keyed import merge_changes
from matchloom.plans import bindings as b
from matchloom.plans import findings as fd
from matchloom.plans import imports as im
from matchloom.plans import ratings as r
from matchloom.plans.bindings import table
from matchloom.session import materialize, scratch_path
from matchloom.sources.catalogs import SnapshotStore


@query("merge_changes", """
    select o_orderkey as k, case when o_orderkey % 3 = 1 or o_orderkey % 2 = 0 then o_orderstatus else 'Z' end as state,
        case when o_orderkey % 3 = 1 then 'absent' when o_orderkey % 3 = 0 then 'inserted'
            when o_orderkey % 2 = 0 then 'untouched' else 'changed' end as change from orders""")
def observation_changes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"))
    old = o.filter("k % 3 <> 0")
    new = o.filter("k % 3 <> 1").withColumn("state", F.when(F.col("k") % 2 == 0, F.col("state")).otherwise("Z"))
    return merge_changes(old, new, ["k"], {"state": "overwrite"}, [F.col("state")])


@query("sync_state", """
    with a as (select user_id as event_id, arg_max(event_type, event_id) as state, arg_max(case when event_id % 3 = 0 then 'e' || event_id else '-' end, event_id) as error,
        max(event_id) as attempt_at, max(event_id) filter (event_id % 3 <> 0) as success_at, max(case when event_id % 3 = 1 then event_id * 2 end) as revision from events group by 1)
    select event_id, state, nullif(error, '-') as error, attempt_at, coalesce(success_at, case when event_id % 2 = 0 then -1 end) as success_at,
        coalesce(revision, case when event_id % 2 = 0 then -1 end) as revision from a""")
def sync_state(spark, sf):
    i = F.col("event_id")
    attempts = table(spark, sf, "events").select(
        F.col("user_id").alias("event_id"), i.alias("attempt_at"), F.col("event_type").alias("state"),
        F.when(i % 3 == 0, F.concat(F.lit("e"), i.cast("string"))).alias("error"), F.when(i % 3 != 0, i).alias("success_at"),
        F.when(i % 3 == 1, i * 2).alias("revision"))
    none = F.lit(None).cast("string")
    current = table(spark, sf, "events").filter("user_id % 2 = 0").select(
        F.col("user_id").alias("event_id"), F.lit("old").alias("state"), none.alias("error"), F.lit(0).cast("long").alias("attempt_at"),
        F.lit(-1).cast("long").alias("success_at"), F.lit(-1).cast("long").alias("revision")).distinct()
    return im.sync_state(current, attempts)


@query("attempt_log", """
    select event_id // 2 as attempt_id, min(event_id) filter (event_id % 2 = 0) as started_at, max(event_id) filter (event_id % 2 = 1) as finished_at,
        coalesce(max(event_type) filter (event_id % 2 = 1), 'running') as status, max(user_id) filter (event_id % 2 = 1) as rows,
        case when max(event_id) filter (event_id % 2 = 1) % 5 = 0 then 'late' end as error from events group by 1""")
def attempt_log(spark, sf):
    i, path = F.col("event_id"), scratch_path(spark, "attempts")
    rows = table(spark, sf, "events").select(
        F.expr("event_id div 2").alias("attempt_id"), F.when(i % 2 == 0, "start").otherwise("finish").alias("kind"), i.alias("at"),
        F.col("event_type").alias("status"), F.col("user_id").alias("rows"), F.when(i % 5 == 0, "late").alias("error"))
    for part in ("start", "finish"):
        im.append_log(rows.filter(F.col("kind") == part), path)
    return im.finish_attempts(spark.read.parquet(path))


@query("decklist_rows", """
    select sha, len(string_split(cards, ',')) as cards, list_sum(list_transform(string_split(cards, ','), lambda x: string_split(x, 'x')[2]::bigint))::bigint as copies
    from (select distinct cards, sha256(cards) as sha from (select string_agg(l_partkey || 'x' || q, ',' order by l_partkey) as cards
        from (select l_orderkey, l_partkey, sum(l_quantity)::bigint as q from lineitem group by 1, 2) group by l_orderkey))""")
def decklist_rows(spark, sf):
    """Headers by content and their rows, written in two batches that overlap."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("copies"))
    decks = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "copies"))).alias("rows"))
    shown = F.array_join(F.transform("rows", lambda x: F.concat_ws("x", x["l_partkey"], x["copies"])), ",")
    root = scratch_path(spark, "decks")
    decks = materialize(decks.select("l_orderkey", "rows", F.sha2(shown, 256).alias("sha")), "decks-read")  # read four times
    for part in ("l_orderkey % 3 <> 0", "l_orderkey % 3 <> 1"):
        some = decks.filter(part)
        im.append_new(some.select("sha"), f"{root}/decks", ["sha"])
        im.append_new(some.select("sha", F.explode("rows").alias("r")).select("sha", "r.*"), f"{root}/rows", ["sha", "l_partkey"])
    stored = spark.read.parquet(f"{root}/decks").join(spark.read.parquet(f"{root}/rows"), "sha")
    return stored.groupBy("sha").agg(F.count(F.lit(1)).cast("long").alias("cards"), F.sum("copies").alias("copies"))


@query("stored_snapshot", """
    select p_partkey::varchar as card_id, case when p_partkey % 7 = 0 then 'new ' || p_name else p_name end as name, 2 as snapshots, 'true,false,true' as created from part""")
def stored_snapshot(spark, sf):
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    cards = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_name").alias("name"))
    renamed = cards.withColumn("name", F.when(F.col("card_id").cast("long") % 7 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")))
    made = [store.write(c, "feed")[1] for c in (cards, cards.orderBy("name"), renamed)]
    return store.latest().select("card_id", "name").withColumn("snapshots", F.lit(store.index().count())).withColumn(
        "created", F.lit(",".join(str(m).lower() for m in made)))


@query("refreshed_read_model", """
    select c_custkey, c_custkey * 2 as projection, 2::int as version, greatest(0, count(*) over () - 100) > 0 as more from customer""")
def refreshed_read_model(spark, sf):
    """A bounded first refresh, a full second one, one with nothing to do, then a new version of everything."""
    model = im.ReadModel(spark, scratch_path(spark, "model"), "c_custkey long, projection long", "c_custkey")
    sources = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    total = sources.count()
    made = [model.refresh(sources, lambda d: d.withColumn("projection", F.col("c_custkey") * m), v, limit)
            for m, v, limit in ((1, 1, 100), (1, 1, total), (1, 1, total), (2, 2, total))]
    if made != [min(100, total), total - min(100, total), 0, total]:
        raise AssertionError(f"refreshes made {made}")
    return model.read().withColumn("more", F.lit(made[1] > 0))


@query("held_for_review", """
    select distinct conv_id as game_id from conversations a where conv_id % 3 <> 0 and exists (select 1 from conversations b where b.conv_id = a.conv_id and b.turn % 2 = 0)
        and exists (select 1 from conversations c where c.conv_id = a.conv_id and length(c.text) % 4 = 1)""")
def held_for_review(spark, sf):
    c = table(spark, sf, "conversations")
    findings = c.select(F.col("conv_id").alias("game_id"), F.when(F.col("turn") % 2 == 0, "Quest Next Turn").otherwise("wait").alias("observation"),
                        F.when(F.length("text") % 4 == 1, "gain LORE").otherwise("hold").alias("recommendation"))
    durations = c.filter("conv_id % 3 <> 0").select(F.col("conv_id").alias("game_id"))
    return fd.held_for_review(findings, durations)


@query("bundle_dates", """
    select o_orderkey as bundle_id, case when o_orderkey % 11 = 0 then 'no_dates' when o_orderkey % 5 = 0 then 'dates_reversed' when o_orderkey % 7 = 0 then 'no_citations' else 'valid' end as problem from orders""")
def bundle_dates(spark, sf):
    k = F.col("o_orderkey")
    return fd.bundle_dates(table(spark, sf, "orders").select(
        k.alias("bundle_id"), F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("effective_from"),
        F.date_add(F.to_date("o_orderdate"), F.when(k % 5 == 0, -1).otherwise(0)).alias("verified_through"),
        F.when(k % 7 == 0, 0).otherwise(3).alias("citations")))


@query("request_allowed", """
    select doc_id, (strlen(coalesce(text, '')) + 1024) * 2.5 / 1000000 + 1200 * 15.0 / 1000000 <= 0.03 and strlen(coalesce(text, '')) + 1024 <= 20000 as allowed from documents""")
def allowed_requests(spark, sf):
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", request_allowed(body, 2.5, 15.0, 1200, 0.03, 20_000).alias("allowed"))


@query("run_counts", """
    select (select count(*) from v_history) // 2 as inputs, (select count(*) from v_history) as history, count(*) as players, count(*) filter (n >= 10) as eligible_players
    from (select player_id, count(*) as n from v_history group by 1)""")
def run_counts(spark, sf):
    return r.run_counts(published(spark, sf), 10)


@query("names_in_documents", """
    select o_orderkey as game_id, '1-' || i as id, 'Card ' || i as name from orders, range(7) r(i)
    union all select o_orderkey, '1-99', 'New' from orders where o_orderkey % 3 = 0
    union all select o_orderkey, '5-' || i, 'Seen' from orders, range(9) r(i) where i <= o_orderkey % 4 + 5 and (o_orderkey + i) % 6 = 0""")
def names_in_documents(spark, sf):
    return id_name_pairs(b.archives(spark, sf), "game_id", "body")
