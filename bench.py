"""Wall time of the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_ALL=1 for every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from matchloom.session import session  # noqa: E402

HEADLINE = """candidate_facts eligibility_global rating_inputs elo_history elo_current leaderboard
leaderboard_min_matches rank_percentile recent_form best_win player_profile tournament_history
event_rollup player_search run_invariants latest_observation matchup_counts matchup_report
weekly_by_member opponent_extremes member_summary practice_history breakdown_top_n team_leaderboard
event_participants usage_by_command usage_overall status_counts fk_violations table_digest
reconcile_tables snapshot_diff merge_upsert due_refresh live_eligible entity_resolution
evidence_package turn_segments own_turns undo_ranges followup_fill page_retrieval flatten_events
flatten_matches parse_history decode_archives replay_actions conform_table usage_stream
incremental_upsert""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                    spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    seconds = {}
    for name in names:
        begin = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
