"""Cards, timelines, retrieval, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from matchloom.functions.text import cost_bound
from matchloom.operators.ordered import segment_runs
from matchloom.operators.quality import citation_problems
from matchloom.plans import bindings as b
from matchloom.plans import cards as c
from matchloom.plans import findings as f
from matchloom.plans import games as g
from matchloom.plans import timeline as t
from matchloom.plans.bindings import table
from matchloom.plans.retrieval import retrieve_pages

SMALL_BLOCK = 512  # several blocks even on the smallest data set


def norm(col):
    return f"trim(regexp_replace(replace(replace(replace(lower({col}), '–', '-'), '—', '-'), '’', ''''), '\\s+', ' ', 'g'))"


RESOLVED = f"""with seen as (select distinct card_id, {norm('observed_name')} as k from v_refs),
 cat as (select *, {norm('name')} as k from v_catalog),
 nm as (select k, count(*) as n, count(distinct (list_sort(ink_colors), coalesce(cost, -1), inkable, card_type, classifications, rules_text, coalesce(strength, -1), willpower, lore, coalesce(move_cost, -1))) = 1 as same,
   arg_min(card_id, (case when collector_number = 'promo' then 1000000000 else collector_number::bigint end, card_id)) as best from cat group by 1),
 per as (select s.card_id, max(o.k) as own, max({norm('a.expected_name')}) as want, count(s.k) as names, count(*) filter (s.k <> o.k) as other, count(*) filter (s.k <> {norm('a.expected_name')}) as odd, coalesce(sum(nm.n), 0) as cand
   from seen s left join cat o on o.card_id = s.card_id left join v_aliases a on a.card_id = s.card_id left join nm on nm.k = s.k group by 1),
 st as (select per.*, nm.best, case when own is not null and other > 0 then 'identity_conflict' when own is not null then 'exact' when want is null then 'unresolved'
   when names <> 1 or odd > 0 then 'alias_identity_unconfirmed' when nm.best is null then 'alias_target_missing' when not same then 'ambiguous_gameplay_data' else 'reviewed_alias' end as status from per left join nm on nm.k = per.want)
 select card_id, status, case when status = 'exact' then card_id when status = 'reviewed_alias' then best end as canonical_card_id, case when status = 'unresolved' then cand else 0 end::bigint as candidates from st"""


def decisions(spark, sf):
    return c.resolve_entities(b.card_references(spark, sf), b.catalog(spark, sf),
                              b.card_aliases(spark, sf))


@query("entity_resolution", RESOLVED)
def entity_resolution(spark, sf):
    return decisions(spark, sf)


@query("entity_status_counts", f"select status, count(*) as cards from ({RESOLVED}) group by 1")
def entity_status_counts(spark, sf):
    return decisions(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("cards"))


@query("evidence_package", f"""with d as ({RESOLVED}), e as (select distinct game_id, card_id from v_refs)
 select game_id, count(*) as cards, count(canonical_card_id) as resolved, count(*) filter (canonical_card_id is null) as missing, min(card_id) filter (canonical_card_id is null) as first_missing from e join d using (card_id) group by 1""")
def evidence_package(spark, sf):
    return c.evidence_summary(c.evidence_cards(b.card_references(spark, sf), decisions(spark, sf)))


@query("card_facts", """select card_id, array_to_string(list_filter([case when cost is null then 'cost' end, case when inkable is null then 'inkable' end, case when card_type is null then 'card_type' end,
  case when card_type = 'Character' and strength is null then 'strength' end, case when card_type in ('Character', 'Location') and willpower is null then 'willpower' end,
  case when card_type in ('Character', 'Location') and lore is null then 'lore' end, case when card_type = 'Location' and move_cost is null then 'move_cost' end, case when len(ink_colors) = 0 then 'ink_colors' end], lambda x: x is not null), ',') as missing,
  contains(lower(rules_text), 'until the start of your next turn') as expires_next_turn from v_catalog""")
def card_facts(spark, sf):
    return b.catalog(spark, sf).select("card_id", F.array_join(c.missing_facts(), ",").alias("missing"),
                                       c.expires_next_turn().alias("expires_next_turn"))


@query("date_coverage", "select o_orderkey, case when o_orderkey % 9 = 0 then 'game_date_unknown' when o_orderdate < timestamp '1996-06-01' then 'before_reference' when o_orderdate::date > date '2000-01-01' then 'after_review' else 'within_reference_window' end as coverage from orders")
def date_coverage(spark, sf):
    day = F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", c.date_coverage(day, "1996-06-01", "2000-01-01").alias("coverage"))


# --- timelines ---------------------------------------------------------------------------

@query("turn_segments", """select game_id, seq, sum(case when active_player is not distinct from a and turn_label is not distinct from l and n > 1 then 0 else 1 end) over (partition by game_id order by seq)::bigint as segment
 from (select *, lag(active_player) over w as a, lag(turn_label) over w as l, row_number() over w as n from v_actions window w as (partition by game_id order by seq))""")
def turn_segments(spark, sf):
    return segment_runs(b.actions(spark, sf), ["game_id"], ["seq"], ["active_player", "turn_label"],
                        rows_per_block=SMALL_BLOCK).select("game_id", "seq", "segment")


OWN = """select * from (select *, sum(case when active_player = 1 and border then 1 else 0 end) over (partition by game_id order by seq) as turns, first_value(active_player) over (partition by game_id order by seq) as fa, first_value(turn_label) over (partition by game_id order by seq) as fl
 from (select *, (active_player is distinct from lag(active_player) over w or turn_label is distinct from lag(turn_label) over w) as border from v_actions where active_player is not null window w as (partition by game_id order by seq))) where fa = 1 and fl = 1"""


@query("own_turns", f"select game_id, seq, case when active_player = 1 then turns end::bigint as own_turn, active_player = 1 and type <> 'undo' as counts from ({OWN})")
def own_turns(spark, sf):
    return t.own_turns(b.actions(spark, sf), 1, 1, SMALL_BLOCK).select(
        "game_id", "seq", "own_turn", "counts")


@query("undo_ranges", """select a.game_id, a.seq, a.type, max(u.seq) is not null as undone, max(u.seq) as undone_by_seq from v_undo a left join v_undo u on u.game_id = a.game_id and u.target_seq <= a.seq and a.seq < u.seq group by 1, 2, 3""")
def undo_ranges(spark, sf):
    return t.invalidate_ranges(b.undo_log(spark, sf), SMALL_BLOCK).select(
        "game_id", "seq", "type", "undone", "undone_by_seq")


FOLLOW = """select game_id, seq, type, case when type = 'click' and card_no is null then coalesce(case when t1 = 'view' then c1 end, case when t1 = 'view' and t2 = 'view' then c2 end, case when t1 = 'view' and t2 = 'view' and t3 = 'view' then c3 end) else card_no end as card_no,
 case when type = 'click' and card_no is null then case when t1 = 'view' and c1 is not null then s1 when t1 = 'view' and t2 = 'view' and c2 is not null then s2 when t1 = 'view' and t2 = 'view' and t3 = 'view' and c3 is not null then s3 end end as filled_from_seq from (select *, """ + ", ".join(
    f"lead(type, {i}) over w as t{i}, lead(card_no, {i}) over w as c{i}, lead(seq, {i}) over w as s{i}" for i in (1, 2, 3)) + " from v_undo window w as (partition by game_id order by seq))"


@query("followup_fill", FOLLOW)
def followup_fill(spark, sf):
    return t.followup_fill(b.undo_log(spark, sf), F.col("type") == "click", F.col("type") == "view",
                           "card_no", rows_per_block=SMALL_BLOCK).select(
        "game_id", "seq", "type", "card_no", "filled_from_seq")


FRAMES = "select user_id as game_id, event_id as seq, case when k % 6 = 5 then null else event_id // 8 - case when k % 10 = 0 then 40 else 0 end end as log_count, 1100 as total_logs, 3 as base_logs from v_ev"


@query("log_slices", f"""with fr as ({FRAMES}), kn as (select *, least(log_count, total_logs) as c from fr), p as (select *, coalesce(last_value(c ignore nulls) over (partition by game_id order by seq rows between unbounded preceding and 1 preceding), base_logs) as before from kn)
 select game_id, seq, before::bigint as first_log, greatest(before, coalesce(c, before))::bigint as end_log, coalesce(log_count < before, false) as decreased, coalesce(log_count > total_logs, false) as clamped from p""")
def log_slices(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    count = F.expr("event_id div 8") - F.when(F.col("k") % 10 == 0, 40).otherwise(0)
    frames = e.select(F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"),
                      F.when(F.col("k") % 6 != 5, count).alias("log_count"),
                      F.lit(1100).cast("long").alias("total_logs"), F.lit(3).cast("long").alias("base_logs"))
    return t.log_slices(frames, SMALL_BLOCK)


@query("action_counts", "select game_id, type, count(*) as actions, count(*) filter (actor = 1) as own_actions from v_actions group by 1, 2")
def action_counts(spark, sf):
    return t.action_counts(b.actions(spark, sf), 1)


@query("first_action_per_turn", "select game_id, turn_label, seq, type from (select *, row_number() over (partition by game_id, turn_label order by seq) as n from v_actions where actor = 1) where n = 1")
def first_action_per_turn(spark, sf):
    return t.first_action_per_turn(b.actions(spark, sf), 1).select("game_id", "turn_label", "seq", "type")


@query("selected_turns", "select game_id, seq, type from v_actions a where turn_label in (1, 2) and 2 = (select count(distinct turn_label) from v_actions x where x.game_id = a.game_id and x.actor = 1 and x.turn_label in (1, 2))")
def selected_turns(spark, sf):
    return t.select_turns(b.actions(spark, sf), 1, [1, 2]).select("game_id", "seq", "type")


TARGETS = ["12", "60", "card 7"]


def opening_rows(spark, sf):
    turns = t.own_turns(b.actions(spark, sf), 1, 1, SMALL_BLOCK)
    hand = F.when(F.col("size") % 4 != 1, F.array(F.struct(
        (F.col("size") % 100).cast("string").alias("id"), F.lit("n").alias("name"))))
    turns = turns.withColumn("hand", hand).withColumn("ready_ink", F.col("size") % 3)
    return turns.withColumn("ink", F.when(F.col("size") % 5 != 0, F.col("size") % 4)).withColumn(
        "card_name", F.when(F.col("size") % 2 == 0, F.concat(F.lit("Card  "), (F.col("size") % 10).cast("string"))))


HIT = "(coalesce(card_id, '') in ('12', '60', 'card 7') or coalesce(case when size % 2 = 0 then 'card ' || (size % 10) end, '') in ('12', '60', 'card 7'))"
OPENING = f"""select game_id, own_turn, complete, end_seq, case when complete then ink end::int as ink, case when complete then ready end::int as ready_ink, case when seen > 0 then true when unseen > 0 then null else false end as target_seen, case when hit > 0 then true when complete and unsure > 0 then null when complete then false end as target_played from (
 select game_id, turns::bigint as own_turn, bool_or(type = 'end_turn') as complete, max(case when type = 'end_turn' then seq end) as end_seq, arg_max_null(case when size % 5 <> 0 then size % 4 end, case when type = 'end_turn' then seq end) as ink, arg_max(size % 3, case when type = 'end_turn' then seq end) as ready, count(*) filter (size % 4 <> 1 and size % 100 in (12, 60)) as seen, count(*) filter (size % 4 = 1) as unseen,
 count(*) filter (type = 'play' and {HIT}) as hit, count(*) filter (type = 'play' and not {HIT} and (card_id is null or size % 2 = 1)) as unsure from ({OWN}) where active_player = 1 and type <> 'undo' and turns <= 3 group by 1, 2)"""


@query("opening_metrics", OPENING)
def opening_metrics(spark, sf):
    return t.opening_metrics(opening_rows(spark, sf), TARGETS)


@query("opening_rates", f"""select own_turn, round(avg(complete::int), 6) as complete_rate, count(complete) as complete_known, round(avg(target_played::int), 6) as target_played_rate, count(target_played) as target_played_known, count(*) as openings from ({OPENING}) group by 1""")
def opening_rates(spark, sf):
    out = g.opening_rates(t.opening_metrics(opening_rows(spark, sf), TARGETS), ["own_turn"],
                          ["complete", "target_played"])
    return out.withColumn("complete_rate", F.round("complete_rate", 6)).withColumn(
        "target_played_rate", F.round("target_played_rate", 6))


@query("mulligan_validation", """select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber % 5 <> 0 and l_suppkey % 4 <> 1 and l_partkey % 6 <> 0 then l_linenumber end::int as mulligan from lineitem""")
def mulligan_validation(spark, sf):
    """Hands built from each line: count = line number, broken by warnings, players or cards."""
    n = F.col("l_linenumber")
    card = lambda i: F.concat(F.lit("c"), (F.col("l_partkey") + i).cast("string"))
    hand = F.transform(F.sequence(F.lit(0), F.lit(6)), card)
    kept, sent = F.slice(hand, n + 1, 7 - n), F.slice(hand, 1, n)
    kept = F.when(n < 7, kept).otherwise(F.array().cast("array<string>"))
    bad = F.col("l_partkey") % 6 == 0
    shown = F.when(bad, F.array_append(F.slice(hand, 1, 6), F.lit("zz"))).otherwise(hand)
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d"), i.cast("string")))
    warnings = F.when(n % 5 == 0, 1).otherwise(0)
    players = F.when(F.col("l_suppkey") % 4 == 1, 3).otherwise(F.when(F.col("l_suppkey") % 4 == 2, 0).otherwise(2))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        t.validated_mulligan(shown, kept, sent, drawn, n, warnings, players).cast("int").alias("mulligan"))


# --- retrieval and findings --------------------------------------------------------------

@query("page_retrieval", """with q as (select item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')), lambda w: w not in ('character','chosen','another','their','there','cards','yours','other')) as terms, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) as name from benchmark),
 p as (select doc_id, lower(text) as text, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) as words from documents),
 s as (select q.item_id, p.doc_id, len(list_intersect(q.terms, p.words)) + case when contains(p.text, q.name) then 20 else 0 end as score from q, p)
 select item_id as request_id, doc_id as page_id, score::bigint as score, rank::int as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 2""")
def page_retrieval(spark, sf):
    requests = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("request_id"), "text",
        F.array(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2))).alias("names"))
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return retrieve_pages(requests, pages)


def findings(spark, sf):
    n = F.length("text")
    turn = F.col("turn")
    word = lambda words, m: F.get(F.array(*[F.lit(w) for w in words]), (n % m).cast("int"))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("finding_id"), F.col("conv_id").alias("game_id"),
        F.when(n % 23 == 0, "  ").otherwise("play").alias("category"), F.lit("seen").alias("observation"),
        F.lit("do").alias("recommendation"), word(["low", "medium", "high", "huge"], 4).alias("impact"),
        word(["fact", "inference", "inference"], 3).alias("claim_type"),
        ((n % 21) / 19.0).alias("confidence"),
        F.when(n % 5 == 0, F.array().cast("array<long>")).otherwise(F.array(turn, turn + n % 3)).alias("action_ids"),
        F.when(n % 10 == 0, F.array().cast("array<long>")).otherwise(
            F.array(F.expr("turn div 2") + 1 + (n % 7 == 0).cast("int"))).alias("turns"),
        word(["replay_observation", "strategic_inference", "rules_interpretation", "guess"], 11).alias("claim_basis"),
        F.when(n % 2 == 0, F.array(F.lit("r1"))).alias("rule_refs"), F.array(F.lit("c1")).alias("card_refs"))


FINDINGS = """select conv_id * 100 + turn as finding_id, conv_id as game_id, turn, length(text) as n, (['low','medium','high','huge'])[length(text) % 4 + 1] as impact, (['fact','inference','inference'])[length(text) % 3 + 1] as claim,
 (['replay_observation','strategic_inference','rules_interpretation','guess'])[length(text) % 11 + 1] as basis from conversations"""


@query("finding_validation", f"""select finding_id, game_id, case when n % 23 = 0 then 'blank_text' when impact = 'huge' then 'invalid_impact' when n % 21 = 20 then 'invalid_confidence' when n % 10 = 0 then 'no_citation'
 when n % 5 <> 0 and not exists (select 1 from conversations c where c.conv_id = x.game_id and c.turn = x.turn + x.n % 3) then 'unknown_action' when basis is null or basis = 'guess' then 'invalid_basis'
 when basis <> 'replay_observation' and claim <> 'inference' then 'not_an_inference' when basis = 'rules_interpretation' and n % 2 = 1 then 'rules_need_sources'
 when n % 10 <> 0 and not exists (select 1 from conversations c where c.conv_id = x.game_id and c.turn // 2 + 1 = x.turn // 2 + 1 + (x.n % 7 = 0)::int) then 'unknown_turn' else 'valid' end as problem from ({FINDINGS}) x""")
def finding_validation(spark, sf):
    return f.finding_problem(findings(spark, sf), b.actions(spark, sf))


@query("citation_check", f"""select finding_id, game_id, seq from (select distinct finding_id, game_id, unnest([turn, turn + n % 3]) as seq from ({FINDINGS}) where n % 5 <> 0) r where not exists (select 1 from conversations c where c.conv_id = r.game_id and c.turn = r.seq)""")
def citation_check(spark, sf):
    return citation_problems(findings(spark, sf), b.actions(spark, sf), ["game_id"], "action_ids",
                             "seq").distinct()


@query("bundle_integrity", """select doc_id as passage_id, case when doc_id not in (select doc_id from labels) then 'unknown_document' when trim(text, ' ') = '' then 'empty_passage' when doc_id % 6 = 0 then 'checksum_mismatch' else 'valid' end as problem from documents""")
def bundle_integrity(spark, sf):
    d = F.col("doc_id")
    passages = table(spark, sf, "documents").select(
        d.alias("passage_id"), d.alias("document_id"), "text",
        F.when(d % 6 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return f.bundle_problem(passages, table(spark, sf, "labels").select(d.alias("document_id")))


@query("request_cost_bound", """select item_id, round(((strlen('{"text":' || to_json(text)::varchar || '}') + 1024) * 2.5::double + 1200 * 15.0::double) / 1000000, 9) as upper_cost from benchmark""")
def request_cost_bound(spark, sf):
    body = F.to_json(F.struct("text"))
    return table(spark, sf, "benchmark").select(
        "item_id", F.round(cost_bound(body, 2.5, 15.0, 1200), 9).alias("upper_cost"))


