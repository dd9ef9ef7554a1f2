"""End-user reports and the remaining state queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import query
from checks.games import EVIDENCE, LABEL, P, evidence, practice
from checks.games import results as game_results
from checks.ratings import published, r6, store
from checks.views import color_pair as pair_sql
from checks.views import outcome as outcome_sql
from matchloom.functions.text import card_ids, deck_fingerprint, text_chunks
from matchloom.operators.keyed import latest_per_key
from matchloom.plans import bindings as b
from matchloom.plans import cards as c
from matchloom.plans import games as g
from matchloom.plans import imports as im
from matchloom.plans import reports as rep
from matchloom.plans.bindings import table
from matchloom.sources import catalogs as cat
from matchloom.sources.history import parse_history_pages

SLUG = "nation_2"
START, END = dt.datetime(2024, 1, 7, 14), dt.datetime(2024, 1, 14, 14)


FRAMES = dict(
    players=b.players, matches=b.matches, events=b.events, rounds=b.rounds, phases=b.phases,
    registrations=b.registrations, members=b.members, memberships=b.memberships, teams=b.teams,
    links=b.player_links, accounts=b.accounts, observations=b.observations, games=b.games,
    replays=b.replays, usage=b.usage)
ROSTER = ["members", "memberships", "teams"]
GAMES = [*ROSTER, "accounts", "observations", "games"]


def library(spark, sf, *names, **kw):
    return rep.Library(**{n: FRAMES[n](spark, sf) for n in names}, **kw)


def rated(spark, sf, *names):
    return library(spark, sf, *names, run=published(spark, sf))


@query("report_player", """select player_id, display_name, round(rating, 6) as rating, rank from v_players left join (select player_id, rating, rank() over (order by rating desc) as rank from v_current) using (player_id)
 where player_id in (select player_id from v_players left join v_current using (player_id) where lower(coalesce(display_name, '')) like '%000000012%' or username like '%000000012%' order by rating desc nulls last, player_id limit 10)""")
def report_player(spark, sf):
    return rep.player(rated(spark, sf, "players"), "000000012").select("player_id", "display_name", r6("rating"), "rank")


@query("report_player_history", """with m as (select match_id, event_id, is_bye, is_draw, winner_id from v_matches where player1_id = 77 or player2_id = 77)
 select event_id, e.name, coalesce(max(g.matches_won), count(*) filter (not is_bye and not is_draw and winner_id = 77))::bigint as wins, count(*) as matches, count(*) filter (match_id in (select match_id from v_inputs)) as rated_matches
 from m join v_events e using (event_id) left join (select * from v_registrations where player_id = 77) g using (event_id) group by 1, 2""")
def report_player_history(spark, sf):
    return rep.player_history(rated(spark, sf, "players", "matches", "events", "rounds", "phases", "registrations"), "77").select(
        "event_id", "name", F.col("wins").cast("long"), "matches", "rated_matches")


@query("report_leaderboard", """select rank, player_id, display_name, round(rating, 6) as rating from (select row_number() over (order by rating desc, matches_played desc, player_id)::int as rank, * from v_current where matches_played >= 4) left join v_players using (player_id) where rank <= 25""")
def report_leaderboard(spark, sf):
    return rep.leaderboard(rated(spark, sf, "players"), 4).select("rank", "player_id", "display_name", r6("rating"))


@query("report_team_leaderboard", f"""select member_id, round(rating, 6) as rating, case when rating is not null then row_number() over (order by rating is null, rating desc, matches_played desc, coalesce(player_id, 0), member_id) end as team_rank
 from v_roster left join (select member_id, player_id from v_links where is_primary) using (member_id) left join v_current using (player_id) where slug = '{SLUG}'""")
def report_team_leaderboard(spark, sf):
    board, _ = rep.team_leaderboard(rated(spark, sf, *ROSTER, "links", "matches", "events"), SLUG, dt.datetime(1998, 3, 1, 12), 60)
    return board.select("member_id", r6("rating"), "team_rank")


@query("report_team_events", f"""select distinct event_id, player_id from v_roster join (select * from v_links where is_primary) using (member_id) join (select event_id, player1_id as player_id from v_matches union select event_id, player2_id from v_matches) using (player_id) join v_events using (event_id)
 where slug = '{SLUG}' and start_datetime >= timestamp '1997-12-31' and start_datetime <= timestamp '1998-03-01 12:00:00'""")
def report_team_events(spark, sf):
    _, recent = rep.team_leaderboard(rated(spark, sf, *ROSTER, "links", "matches", "events"), SLUG, dt.datetime(1998, 3, 1, 12), 61)
    return recent.select("event_id", "player_id")


@query("report_command_stats", "select command_name, count(*) as uses, count(distinct user_id) as users from v_usage where occurred_at >= timestamp '2024-01-21' group by 1")
def report_command_stats(spark, sf):
    return rep.command_stats(library(spark, sf, "usage"), dt.datetime(2024, 1, 31), 10)[0].select(
        "command_name", "uses", "users")


@query("report_database_status", "select count(*) as total, count(*) filter (participant_count = 2) as two_player, count(*) filter (participant_count > 2) as multi, count(*) filter (participant_count is null) as unknown from v_matches")
def report_database_status(spark, sf):
    return rep.database_status(library(spark, sf, "matches"))


@query("report_championships", "select event_id, name, s_name as store, n_name as country from v_events join supplier on s_suppkey = store_id join nation on n_nationkey = s_nationkey where lower(n_name) = 'nation_4' and lower(name) like '%event 2%'")
def report_championships(spark, sf):
    stores = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.col("n_name").alias("country"))
    return rep.championships(library(spark, sf, "events", stores=stores), "country", ["nation_4"], "Event 2")


TEAMED = "v_results where member_id in (select member_id from v_configured where slug = '{slug}')".format(slug=SLUG)
W = "started_at >= timestamp '2024-01-07 14:00:00' and started_at < timestamp '2024-01-14 14:00:00'"
PIVOT = ", ".join(f"count(*) filter (outcome = '{o}') as {o}" for o in g.OUTCOME_NAMES)


@query("report_weekly", f"""select member_id, colors, coalesce(win, 0) as win, coalesce(loss, 0) as loss, coalesce(draw, 0) as draw, coalesce(unknown, 0) as unknown from (select * from v_configured where slug = '{SLUG}') left join
 (select member_id, colors, {PIVOT} from (select member_id, {pair_sql('your_deck_colors')} as colors, {outcome_sql('result')} as outcome from {TEAMED} and {W}) group by 1, 2) using (member_id)""")
def report_weekly(spark, sf):
    rows, _, _ = rep.weekly(library(spark, sf, *GAMES), SLUG, START, END)
    return rows.select("member_id", "colors", *g.OUTCOME_NAMES)


@query("report_weekly_coverage", f"select c.member_id, max(last_sync_completed_at) as last_sync, max(last_sync_completed_at) is not null as synced from v_configured c join v_accounts a using (member_id) where slug = '{SLUG}' group by 1")
def report_weekly_coverage(spark, sf):
    _, _, cover = rep.weekly(library(spark, sf, *GAMES), SLUG, START, END)
    return cover.select("member_id", "last_sync", "synced")


@query("report_team_summary", f"""with e as ({EVIDENCE}) select c.member_id, count(r.game_id) as games, round(avg(e.mulligan_count), 6) as mulligan_average, count(*) filter (projection_pending) as pending from (select * from v_configured where slug = '{SLUG}') c
 left join (select * from {TEAMED} and {W}) r on r.member_id = c.member_id left join e on e.member_id = r.member_id and e.game_id = r.game_id group by 1""")
def report_team_summary(spark, sf):
    return rep.team_summary(library(spark, sf, *GAMES, "replays"), SLUG, START, END).select(
        "member_id", "games", F.round("mulligan_average", 6).alias("mulligan_average"), "pending")


@query("report_matchups", f"""select member_id, ours, theirs, sum(games)::bigint as games from (select r.member_id, {pair_sql('your_deck_colors')} as ours, {pair_sql('opponent_deck_colors')} as theirs, 1 as games,
  (select count(*) from v_latest_obs o where o.game_id = r.game_id and o.member_id in (select member_id from v_roster where slug = '{SLUG}')) as seen from {TEAMED.replace('v_results', 'v_results r')} and {W}) where seen = 1 group by 1, 2, 3""")
def report_matchups(spark, sf):
    rows = rep.matchups(library(spark, sf, *GAMES), SLUG, START, END)
    return rows.groupBy("member_id", "ours", "theirs").agg(F.sum("games").alias("games"))


@query("report_practice", f"""select member_id, deck_label, count(*) filter (outcome = 'win') as wins, count(*) as games from (select p.*, {LABEL} as deck_label from ({P} and member_id in (select member_id from v_roster where slug = '{SLUG}') and ranked) p) where deck_label = 'Ruby/Sapphire' group by 1, 2""")
def report_practice(spark, sf):
    _, record = rep.practice(library(spark, sf, *GAMES, "replays"), SLUG, dt.datetime(2024, 1, 28), 20, True,
                             profile="ruby_sapphire")
    return record.select("member_id", "deck_label", "wins", "games")


# --- remaining operators -----------------------------------------------------------------

DECK = "sha256('[[\"' || your_deck_colors[1] || '\",1]]')"


@query("practice_deck_prefix", f"select member_id, game_id from (select p.*, {DECK} as deck_id from ({P}) p) where starts_with(deck_id, substr(sha256('[[\"ruby\",1]]'), 1, 12))")
def practice_deck_prefix(spark, sf):
    import hashlib
    prefix = hashlib.sha256(b'[["ruby",1]]').hexdigest()[:12]
    rows = practice(spark, sf).withColumn("deck_id", deck_fingerprint(F.slice("your_deck_colors", 1, 1)))
    return g.practice_filter(rows, deck=prefix).select("member_id", "game_id")


@query("ambiguous_deck_prefixes", f"select member_id, substr(deck_id, 1, 1) as prefix, count(distinct deck_id) as decks from (select member_id, {DECK} as deck_id from v_results) where deck_id is not null group by 1, 2 having count(distinct deck_id) > 1")
def ambiguous_deck_prefixes(spark, sf):
    decks = game_results(spark, sf).select("member_id", deck_fingerprint(F.slice("your_deck_colors", 1, 1)).alias("deck_id"))
    return g.ambiguous_prefixes(decks, 1)


@query("opening_sample", f"select member_id, game_id from (select p.member_id, p.game_id, row_number() over (partition by p.member_id order by p.game_rank) as n from ({P}) p join ({EVIDENCE}) e using (member_id, game_id)) where n <= 10")
def opening_sample(spark, sf):
    return g.opening_sample(practice(spark, sf), 10).select("member_id", "game_id")


@query("evidence_ownership", f"select member_id, game_id, normalization_id from ({EVIDENCE}) where member_id in (select member_id from v_roster where slug = '{SLUG}')")
def evidence_ownership(spark, sf):
    own = rep.Library(members=b.members(spark, sf), memberships=b.memberships(spark, sf), teams=b.teams(spark, sf)).roster(SLUG)
    return g.scope_to_owner(evidence(spark, sf), own).select("member_id", "game_id", "normalization_id")


SYNC = """select user_id as account_id, event_id as log_id, ts as seen, (['begin','checkpoint','finish','error','checkpoint'])[k % 5 + 1] as kind, 'c' || k as cursor, k % 2 = 0 as history_exhausted, k % 3 = 0 as auth_error, 'E' || (k % 4) as error_category, 'text ' || k as error_text from v_ev"""


@query("account_sync_state", f"""select account_id, arg_max(case when kind = 'error' and auth_error then 'auth_error' else 'active' end, (seen, log_id)) filter (kind in ('finish', 'error')) as status, arg_max(cursor, (seen, log_id)) filter (kind in ('checkpoint', 'finish')) as sync_cursor,
 arg_max(history_exhausted, (seen, log_id)) filter (kind in ('checkpoint', 'finish')) as history_exhausted, max(seen) filter (kind = 'begin') as last_sync_started_at, max(seen) filter (kind = 'finish') as last_sync_completed_at,
 nullif(arg_max(case when kind = 'error' then error_category else '' end, (seen, log_id)) filter (kind in ('begin', 'finish', 'error')), '') as last_error_category, nullif(arg_max(case when kind = 'error' then error_text else '' end, (seen, log_id)) filter (kind in ('begin', 'finish', 'error')), '') as last_error_summary
 from ({SYNC}) group by 1""")
def account_sync_state(spark, sf):
    k = F.col("k")
    kinds = F.array(*[F.lit(x) for x in ("begin", "checkpoint", "finish", "error", "checkpoint")])
    log = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.col("user_id").alias("account_id"), F.col("event_id").alias("log_id"), F.col("ts").alias("at"),
        F.get(kinds, k % 5).alias("kind"), F.concat(F.lit("c"), k.cast("string")).alias("cursor"),
        (k % 2 == 0).alias("history_exhausted"), (k % 3 == 0).alias("auth_error"),
        F.concat(F.lit("E"), (k % 4).cast("string")).alias("error_category"),
        F.concat(F.lit("text "), k.cast("string")).alias("error_text"))
    return im.account_sync_state(log)


def windows(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(e % 50 != 0, e).alias("id"), F.when(e % 40 != 1, F.col("ts")).alias("at"), e.alias("ord"), "event_type")
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    log = days.select("day", F.when(F.dayofmonth("day") % 3 == 0, "completed").otherwise("failed").alias("status"))
    target = table(spark, sf, "events").filter((e % 4 == 0) & (e % 50 != 0)).select(
        e.alias("id"), "event_type")
    return im.ingest_window(rows, target, log, dt.date(2024, 1, 3), dt.date(2024, 1, 21), "id", "at", "ord")


NEW = "event_id % 50 <> 0 and event_id % 40 <> 1 and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-21' and day(ts) % 3 <> 0"


@query("ingest_run", f"select event_id as id, event_type from events where (event_id % 4 = 0 and event_id % 50 <> 0) or ({NEW})")
def ingest_run(spark, sf):
    return windows(spark, sf)[0]


@query("ingest_totals", f"select 'completed' as status, count(distinct ts::date) as windows, count(*) as received, count(*) filter ({NEW}) as selected from events where event_id % 40 <> 1 and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-21' and day(ts) % 3 <> 0")
def ingest_totals(spark, sf):
    return im.ingest_totals(windows(spark, sf)[1])


@query("latest_error", "select user_id, max(event_id) as last_id, arg_max(case when event_type = 'error' then props else '' end, event_id) as last_error from events group by 1")
def latest_error(spark, sf):
    log = table(spark, sf, "events").withColumn("err", F.when(F.col("event_type") == "error", F.col("props")))
    return im.latest_error(log, ["user_id"], "event_id", "err").withColumn(
        "last_error", F.coalesce("last_error", F.lit("")))


@query("latest_report", "select game_id, report_id from (select event_id // 4 as game_id, event_id as report_id, row_number() over (partition by event_id // 4 order by ts desc, event_id desc) as n from events join v_replays r on r.replay_id = event_id where event_type <> 'error' and r.status = 'valid') where n = 1")
def latest_report(spark, sf):
    runs = table(spark, sf, "events").filter(F.col("event_type") != "error").select(
        F.col("event_id").alias("report_id"), F.col("ts").alias("completed_at"))
    valid = b.replays(spark, sf).filter(F.col("status") == "valid").select("replay_id", "game_id")
    rows = runs.join(valid, runs.report_id == valid.replay_id)
    return latest_per_key(rows, ["game_id"], [F.col("completed_at").desc(), F.col("report_id").desc()]).select(
        "game_id", "report_id")


@query("published_run", "select 'validated' as status, 'global_elo_v1' as policy, 1500.0::double as start_rating, 32.0::double as k_factor, count(*) as input_count from v_inputs")
def published_run(spark, sf):
    published(spark, sf)
    pointer = store(spark).publications().filter(F.col("publication") == f"global_elo@{sf}").select(
        F.col("current_run").alias("run_id"))
    return store(spark).runs().join(pointer, "run_id").select(
        "status", "policy", "start_rating", "k_factor", "input_count")


@query("catalog_by_ids", "select card_id, name, cost from v_catalog where card_id in (select l_partkey::varchar from lineitem where l_quantity > 49)")
def catalog_by_ids(spark, sf):
    ids = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 49).select(F.col("l_partkey").cast("string").alias("card_id"))
    return c.cards_by_ids(b.catalog(spark, sf), ids).select("card_id", "name", "cost")


@query("card_ids_in_documents", """select o_orderkey as game_id, array_to_string(list_sort(list_distinct(list_filter(['1-0','1-1','1-2','1-3','1-4','1-5','1-6', case when o_orderkey % 3 = 0 then '1-99' end], lambda x: x is not null) || list_transform(list_filter(range(2, o_orderkey % 4 + 6), lambda i: (o_orderkey + i) % 6 = 0), lambda i: '5-' || i)
  || list_transform(list_filter(range(0, 2), lambda i: (o_orderkey + i) % 6 = 0), lambda i: '5-' || i))), ',') as ids from orders""")
def card_ids_in_documents(spark, sf):
    return b.archives(spark, sf).select("game_id", F.array_join(card_ids(F.col("body")), ",").alias("ids"))


CH = """select doc_id, 0 as n, null::varchar as piece, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) as rest from documents"""


@query("text_chunks", f"""with recursive ch as ({CH} union all (with s as (select *, case when length(rest) > 500 then substr(rest, 1, 500) end as h from ch where length(rest) > 0),
 p as (select *, strpos(reverse(h), chr(10) || chr(10)) as r2, strpos(reverse(h), chr(10)) as r1 from s),
 q as (select *, case when h is null then length(rest) when r2 > 0 and 500 - r2 - 1 >= 250 then 500 - r2 - 1 when r1 > 0 and 500 - r1 >= 250 then 500 - r1 else 500 end as c from p)
 select doc_id, n + 1, case when h is null then rest else rtrim(substr(rest, 1, c), chr(32) || chr(10) || chr(9) || chr(13)) end, case when h is null then '' else ltrim(substr(rest, c + 1), chr(32) || chr(10) || chr(9) || chr(13)) end from q))
 select doc_id, n::int as n, piece from ch where n > 0""")
def document_chunks(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(text_chunks(F.col("text"), 500)).alias("n", "piece")).withColumn("n", F.col("n") + 1)


@query("history_pages", """select conv_id, turn, i::int as position, 'g' || i as game_id, case when turn % 4 = 1 then null else 'c' || conv_id end as next_cursor, case when turn % 5 = 0 then 'invalid_games' end as error from conversations, range(-1, 4) r(i)
 where case when turn % 5 = 0 then i = -1 else i >= 0 and i < length(text) % 4 end""".replace("i::int as position, 'g' || i as game_id", "case when i >= 0 then i end::int as position, case when i >= 0 then 'g' || i end as game_id"))
def history_pages(spark, sf):
    n = (F.length("text") % 4).cast("int")
    games = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(
        F.lit('{"game_id":"g'), i.cast("string"), F.lit('"}'))), ",")).otherwise("")
    page = F.concat(F.lit('{"games":'), F.when(F.col("turn") % 10 == 0, F.lit('"x"')).when(F.col("turn") % 5 == 0, F.lit("[1]"))
                    .otherwise(F.concat(F.lit("["), games, F.lit("]"))), F.lit(',"next_cursor":'),
                    F.when(F.col("turn") % 4 == 1, F.lit("null")).otherwise(F.concat(F.lit('"c'), F.col("conv_id").cast("string"), F.lit('"'))), F.lit("}"))
    rows = parse_history_pages(table(spark, sf, "conversations").select("conv_id", "turn", page.alias("page")))
    return rows.select("conv_id", "turn", "position", F.get_json_object("body", "$.game_id").alias("game_id"), "next_cursor", "error")


@query("normalize_cards", """select p_partkey, case when p_partkey % 2 = 0 then p_partkey::varchar else 'alt-' || p_partkey end as card_id, case when p_partkey % 9 = 0 then null else p_name end as name, case when p_partkey % 5 not in (1, 2) then p_size end::int as cost, case when p_partkey % 6 in (2, 3) then true end as inkable, case when p_partkey % 3 = 0 then 'ruby' when p_partkey % 3 = 1 then 'steel' else '' end as colours,
 array_to_string(list_filter([case when p_partkey % 9 = 0 then 'name' end, case when p_partkey % 5 = 1 then 'cost' end, case when p_partkey % 6 in (0, 1) then 'inkable' end], lambda x: x is not null), ',') as errors from part""")
def normalize_cards(spark, sf):
    p = F.col("p_partkey")
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    body = t("{", F.when(p % 2 == 0, t('"id":"', p, '"')).otherwise(t('"id":"","card_id":"alt-', p, '"')),
             F.when(p % 9 == 0, F.lit(',"name":" "')).otherwise(t(',"name":"', F.col("p_name"), '"')),
             ',"cost":', F.when(p % 5 == 1, F.lit("true")).when(p % 5 == 2, F.lit("null")).otherwise(F.col("p_size").cast("string")),
             ',"inkable":', F.when(p % 6 < 2, F.lit("1")).when(p % 6 < 4, F.lit("true")).otherwise(F.lit("null")),
             F.when(p % 3 == 0, F.lit(',"ink_colors":["Ruby "]')).when(p % 3 == 1, F.lit(',"colors":["STEEL",""]')).otherwise(F.lit(',"ink_colors":null')), "}")
    return cat.normalize_cards(table(spark, sf, "part").select(p, body.alias("body"))).select(
        "p_partkey", "card_id", "name", "cost", "inkable", F.array_join("ink_colors", ",").alias("colours"),
        F.array_join("errors", ",").alias("errors"))


@query("rule_passages", "select 'CR:v2:p' || item_id as passage_id, sha256(text) as sha256 from benchmark")
def rule_passages(spark, sf):
    pages = table(spark, sf, "benchmark").select(F.col("item_id").alias("page"), F.lit("cr").alias("document_id"), "text")
    return cat.rule_pages(pages, "v2").select("passage_id", "sha256")




def review(spark, sf, turns=None):
    actions = b.actions(spark, sf)
    refs = actions.filter(F.col("card_id").isNotNull()).select(
        "game_id", "card_id", F.lit(None).cast("string").alias("observed_name"))
    pages = table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit(" gains at the start of "), "p_type").alias("text"))
    return rep.review_plan(actions, 1, refs, b.catalog(spark, sf), b.card_aliases(spark, sf), pages, turns)


FACTS = """select distinct game_id, card_id, name, rules_text from v_actions
 join (select game_id, min(turn_label) as turn_label from v_actions where actor = 1 group by 1) using (game_id, turn_label)
 join v_catalog using (card_id)"""


@query("review_pages", f"""with f as ({FACTS}), q as (select game_id, list_distinct(flatten(list(list_filter(regexp_extract_all(lower(rules_text), '[a-z]{{5,}}'), lambda w: w not in ('their', 'yours', 'other'))))) as terms, list_distinct(list(lower(name))) as names from f group by 1),
 p as (select p_partkey as page_id, lower(p_name || ' gains at the start of ' || p_type) as text, list_distinct(regexp_extract_all(lower(p_name || ' gains at the start of ' || p_type), '[a-z]{{5,}}')) as words from part),
 s as (select game_id as request_id, page_id, len(list_intersect(terms, words)) + 20 * len(list_filter(names, lambda n: contains(text, n))) as score from q, p)
 select request_id, page_id, score::bigint as score, rank::int as rank from (select *, row_number() over (partition by request_id order by score desc, page_id) as rank from s where score > 0) where rank <= 2""")
def review_pages(spark, sf):
    return review(spark, sf)["pages"]


@query("review_durations", f"select game_id, card_id, name from ({FACTS}) where contains(lower(rules_text), 'until the start of your next turn')")
def review_durations(spark, sf):
    return review(spark, sf)["durations"]
