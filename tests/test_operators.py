import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.operators import digest as d
from matchloom.operators import keyed as k
from matchloom.operators import quality as q
from matchloom.operators.components import component_labels
from matchloom.operators.ordered import assign_sequence, number, running, segment_runs, shifted


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def log(spark, n=200, hot=0.5, seed=3):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < hot else rnd.randrange(6), i, rnd.choice([None, rnd.randrange(50)]),
             rnd.choice("aab")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "game long, seq long, v long, label string")


def test_assign_sequence_is_the_total_order(spark):
    rows, df = log(spark)
    got = [x.sequence for x in assign_sequence(df, [F.col("game"), F.col("seq").desc()]).orderBy(
        "game", F.col("seq").desc()).collect()]
    assert got == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_running_and_shifted_across_blocks(spark, block):
    rows, df = log(spark)
    base = number(df, ["game"], ["seq"], block)
    got = running(shifted(base, ["game"], {"p": (-1, "seq"), "n2": (2, "seq")}, block), ["game"],
                  {"total": ("sum", "v"), "high": ("max", "v"), "last": ("last", "v")}, block)
    seen = {(x.game, x.seq): x for x in got.collect()}
    assert len(seen) == len(rows)
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for i, row in enumerate(mine):
            vals = [r[2] for r in mine[:i + 1] if r[2] is not None]
            x = seen[(g, row[1])]
            assert x.p == (mine[i - 1][1] if i else None)
            assert x.n2 == (mine[i + 2][1] if i + 2 < len(mine) else None)
            assert (x.total, x.high, x.last) == ((sum(vals), max(vals), vals[-1]) if vals else (None,) * 3)


@pytest.mark.parametrize("block", [5, 1000])
def test_segment_runs(spark, block):
    rows, df = log(spark)
    seen = {(x.game, x.seq): x.segment for x in segment_runs(
        df, ["game"], ["seq"], ["label"], rows_per_block=block).collect()}
    for g in {r[0] for r in rows}:
        n, last = 0, object()
        for _, seq, _, label in [r for r in rows if r[0] == g]:
            n, last = (n + (label != last), label)
            assert seen[(g, seq)] == n


def test_top_per_key_is_limited_before_the_shuffle(spark):
    _, df = log(spark)
    text = plan(k.latest_per_key(df, ["game"], [F.col("seq").desc()]))
    first = text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[first:], "the map side must drop rows below the exchange"


def test_chained_block_operators_shuffle_once(spark):
    _, df = log(spark)
    base = number(df, ["game"], ["seq"])
    text = plan(running(shifted(base, ["game"], {"p": (-1, "seq")}), ["game"], {"t": ("sum", "v")}))
    main = text[:text.index("BroadcastExchange")] if "BroadcastExchange" in text else text
    assert main.count("Exchange hashpartitioning(_block") == 1


def test_components(spark):
    edges = [(1, 1, 2), (1, 2, 3), (1, 5, 6), (2, 1, 9), (2, 3, 4)] + [(3, i, i + 1) for i in range(40)]
    df = spark.createDataFrame(edges, "epoch long, a long, b long")
    got = {(x.epoch, x.node): x.component for x in component_labels(df, ["epoch"], "a", "b").collect()}
    assert got[(1, 1)] == got[(1, 3)] != got[(1, 5)]
    assert got[(2, 1)] == got[(2, 9)] != got[(2, 3)]
    assert len({v for (e, _), v in got.items() if e == 3}) == 1


def test_merge_rules(spark):
    target = spark.createDataFrame([(1, "a", 1, None), (2, "b", 2, "f")], "id long, name string, n int, first string")
    updates = spark.createDataFrame([(1, None, None, "u", 1), (1, "late", None, "v", 2), (3, "c", 3, "w", 1)],
                                    "id long, name string, n int, first string, at int")
    got = {x.id: tuple(x)[1:] for x in k.merge_upsert(
        target, updates, ["id"], {"name": "overwrite", "n": "prefer_new", "first": "keep_first"},
        [F.col("at").desc()]).collect()}
    assert got == {1: ("late", 1, "v"), 2: ("b", 2, "f"), 3: ("c", 3, "w")}
    only_null = updates.filter("at = 1 and id = 1")
    row = k.merge_upsert(target, only_null, ["id"], {"name": "overwrite"}, [F.col("at")]).filter("id = 1").first()
    assert row.name is None and row.n == 1


def test_top_n_with_other(spark):
    df = spark.createDataFrame([("s", f"d{i:02}", i) for i in range(15)] + [("t", "x", 1)],
                               "scope string, label string, size long")
    got = k.top_n_with_other(df, ["scope"], "label", "size", 12).collect()
    other = [x for x in got if x.is_other]
    assert len(got) == 14 and [(x.label, x["size"]) for x in other] == [("Other 3 groups", 3)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["", "a", None])), min_size=1, max_size=12), st.randoms())
def test_table_digest_ignores_order_but_not_copies(spark, rows, rnd):
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    make = lambda r: d.table_digest(spark.createDataFrame(r, "a long, b string"), ["a", "b"]).first()
    assert make(rows) == make(shuffled)
    assert make(rows).digest != make(rows + rows[:1]).digest


def test_ordered_digest_depends_on_order(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(1, 31)], "sequence long, line string")
    a = d.ordered_digest(df, "sequence", F.col("line"), 4).first()
    b = d.ordered_digest(df.withColumn("sequence", 31 - F.col("sequence")), "sequence", F.col("line"), 4).first()
    assert a.row_count == 30 and a.digest != b.digest
    assert a == d.ordered_digest(df.repartition(3), "sequence", F.col("line"), 4).first()


def test_quality(spark):
    child = spark.createDataFrame([(1,), (1,), (7,), (None,)], "fk long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert q.fk_violations([("r", child, "fk", parent, "id")]).first().orphans == 1
    assert q.check_schema(parent, {"id": "bigint", "x": "int"}) == ["missing column x"]
    assert [x.fk for x in q.duplicates(child, ["fk"]).collect()] == [1]


def test_insert_ignore_and_content_addressing(spark):
    t = spark.createDataFrame([(1, "old")], "id long, v string")
    u = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id long, v string")
    assert sorted(map(tuple, k.insert_ignore(t, u, ["id"], [F.col("v")]).collect())) == [(1, "old"), (2, "a")]
    first = k.content_addressed_append(spark.createDataFrame([], "sha string"), u, ["id", "v"])
    assert first.filter("created").count() == 3
    assert k.content_addressed_append(first, u, ["v", "id"]).filter("created").count() == 0


def test_case_folding_equals_the_standard_on_every_code_point(spark):
    from matchloom.functions.text import casefold
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i:i + 1000]) for i in range(0, len(every), 1000)] + ["", "ΟΔΟΣ Σ", "ﬁx ŉ µ ϐ", "STRASSE ß ẞ", "İ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", casefold(F.col("t")).alias("f")).collect():
        assert r.f == (None if r.t is None else r.t.casefold())


def test_pairs_of_ids_and_names_at_any_depth(spark):
    import json
    from matchloom.functions.text import id_name_pairs
    value = {"id": "a", "name": "A", "x": [{"card_id": "", "id": "b", "card_name": "B"}, [[{"card_id": "c", "name": "C", "id": "d"}]],
             {"id": 5, "name": "n"}, {"id": "e", "name": "  "}, {"id": "f"}, {"card_id": 0, "id": "g", "name": "G", "y": {"id": "a", "name": "A"}},
             {"card_id": {}, "id": "h", "name": "H"}, {"card_id": [1], "id": "i", "name": "I"}, None, "text"]}
    docs = spark.createDataFrame([(1, json.dumps(value)), (2, "not json"), (3, None), (4, "[]")], "k long, body string")
    got = sorted(tuple(r) for r in id_name_pairs(docs, "k", "body").collect())
    assert got == [(1, "a", "A"), (1, "b", "B"), (1, "c", "C"), (1, "g", "G"), (1, "h", "H")]


def test_pairs_of_ids_and_names_read_a_document_once(spark):
    import glob
    from matchloom.functions.text import id_name_pairs
    from matchloom.session import shared_dir
    bodies = ['{"id":"a","name":"A"} tail', '{"id":"b","id":"c","name":"B"}', '{"id":NaN,"x":{"id":"d","name":"D"}}',
              '{"card_id":0.0,"id":"e","name":"E"}', '{"card_id":0e0,"id":"f","name":"F"}', '{"card_id":"0","id":"g","name":"G"}',
              '{"id":"h","card_name":"false","name":"H"}', '{"id":"\\ud800","name":"I"}', '{"id":"j","name":"\\t"}', "", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "k int, body string").repartition(3)
    levels = f"{shared_dir(spark)}/matchloom/{spark.sparkContext.applicationId}/json-level*"
    before = len(glob.glob(levels))
    found = id_name_pairs(docs, "k", "body")
    assert sorted(map(tuple, found.collect())) == [(0, "a", "A"), (3, "e", "E"), (5, "g", "G"), (6, "h", "H"), (7, "?", "I"), (8, "j", "\t")]
    assert len(glob.glob(levels)) == before and found.columns == ["k", "id", "name"]


def test_keyed_table_keeps_its_bucket_count(spark):
    from matchloom.session import scratch_path
    from matchloom.streaming.jobs import KeyedTable
    root = scratch_path(spark, "kept-buckets")
    schema, order = "k long, v long", [F.col("v").desc()]
    KeyedTable(spark, root, schema, ["k"], 5).upsert(spark.range(40).selectExpr("id k", "id v"), 0, {"v": "overwrite"}, order)
    again = KeyedTable(spark, root, schema, ["k"])
    assert again.buckets == 5
    again.upsert(spark.range(10, 50).selectExpr("id k", "id * 10 v"), 1, {"v": "overwrite"}, order)
    assert sorted(map(tuple, again.read().collect())) == [(k, k if k < 10 else k * 10) for k in range(50)]


def test_components_of_long_chains_take_few_steps(spark, monkeypatch):
    import random
    from matchloom.operators import components
    written = []
    plain = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or plain(df, label))
    places = list(range(300))
    random.Random(5).shuffle(places)
    rows = [(s, a + 10 * s, b + 10 * s) for s in (1, 2) for a, b in zip(places, places[1:]) if (a + b) % 97]
    rows += [(1, 5000, 5000), (2, None, 3), (2, 6000, 7000)]
    rows += [(3, 0, 90)] + [(3, a, a - 1) for a in range(90, 1, -1)]  # the smallest node is far from the next
    found = components.component_labels(spark.createDataFrame(rows, "s int, a long, b long"), ["s"], "a", "b").collect()
    assert len(written) <= 60
    group = {}
    for s, a, b in rows:
        if a is not None:
            one, two = (group.setdefault((s, x), [x]) for x in (a, b))
            if one is not two:
                one += two
                group.update({(s, x): one for x in two})
    assert {(r.s, r.node): r.component for r in found} == {k: min(v) for k, v in group.items()}
