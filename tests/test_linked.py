"""Components, resolution, paths, tables by key, trigrams, positions, numbering, JSON levels and the stateful stream."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import variant
from tradeloom.operators import connect, graph, keyed, names, ontology, paths, positions
from tradeloom.plans.numbering import numbered
from tradeloom.plans.storage import written
from tradeloom.streaming import events, turns


def plain_components(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up if any(x in link and link[0] != link[1] for link in links)}


def test_components_of_chains_hubs_and_random_links(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 400)]
    hub = [(1000, 1001 + k) for k in range(500)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    links = chain + hub + loose + [(5, 5), (3000, 3000)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connect.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(links)
    assert connect.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resolution_cuts_conflicts_out_and_reports_them(spark):
    keys = [
        ("a", "LEI", "1"), ("b", " lei", " 1 "), ("b", "Duns", "X"), ("c", "DUNS", "x"), ("c", "isin", "5"), ("d", "ISIN", "5"),  # a chain of four, one registered
        ("e", "LEI", "7"), ("f", "LEI", "7"), ("f", "DUNS", "8"),  # nothing registered
        ("g", "LEI", "20"), ("g", "DUNS", "30"), ("h", "LEI", "20"), ("i", "DUNS", "30"), ("i", "ISIN", "31"), ("h", "ISIN", "21"),  # two registered, three steps apart
        ("j", "LEI", "40"), ("j", "DUNS", "41"), ("k", "LEI", "40"), ("l", "DUNS", "41"),  # j itself names two
        ("m", "EMAIL", "a@b.c"), ("m", "LEI", "7"), (None, "LEI", "7"), ("n", "LEI", None),
        ("o", "CORP_CODE", "60"), ("p", "STOCK_CODE", "61"),  # joined by the entity that has both
    ]
    own = [("E1", "ISIN", "5"), ("E2", "ISIN", "21"), ("E3", "ISIN", "31"), ("E4", "LEI", "40"), ("E5", "DUNS", "41"), ("E6", "corp-code", "60"), ("E6", "STOCK CODE".replace(" ", "_"), "61")]
    candidates = spark.createDataFrame([(c, "COMPANY", s, v) for c, s, v in keys], "candidate string, entity_type string, scheme string, value string")
    registered = spark.createDataFrame([("COMPANY", s, v, e) for e, s, v in own] + [("PORT", "LEI", "7", "P1")], "entity_type string, scheme string, value string, entity_id string")
    got = {r.candidate: (r.status, r.entity_id, r.leader, r.claims) for r in connect.resolve_records(candidates, registered).collect()}
    want = dict.fromkeys("abcd", ("MATCHED", "E1", None, 1)) | dict.fromkeys("ef", ("NEW", None, "e", 0)) | dict.fromkeys("ghi", ("CONFLICT", None, None, 2))
    want |= {"j": ("REFUSED", None, None, 2), "k": ("MATCHED", "E4", None, 1), "l": ("MATCHED", "E5", None, 1), "m": ("UNTRUSTED", None, None, 0)} | dict.fromkeys("op", ("MATCHED", "E6", None, 1))
    assert got == want


MESH = [("1", "A", "x", "y"), ("2", "B", "x", "y"), ("3", "A", "y", "z"), ("4", "A", "z", "x"), ("5", "A", "z", "z"), ("6", "C", "z", "w")]


def plain_trails(edges, root, depth, simple=False):
    out = []

    def walk(nodes, used):
        if len(used) < depth:
            for i, _, a, b in sorted(edges, key=lambda e: (e[1], e[0])):
                for to in {b} if nodes[-1] == a else {a} if nodes[-1] == b else ():
                    if (to not in nodes) if simple else (i not in used):
                        out.append((tuple([*nodes, to]), tuple([*used, i])))
                        walk([*nodes, to], [*used, i])

    walk([root], [])
    return out


def test_trails_differ_from_simple_paths(spark):
    e = spark.createDataFrame(MESH, "id string, type string, source string, target string")
    root = spark.sql("SELECT 'x' AS node")
    got = [(tuple(r.nodes), tuple(r.edges)) for r in paths.trails(e, root, 4).collect()]
    assert sorted(got) == sorted(plain_trails(MESH, "x", 4)) and len(set(got)) == len(got)
    simple = {tuple(r.nodes) for r in graph.simple_paths(e, root, 4).collect()}
    assert ("x", "y", "x") in {n for n, _ in got} and ("x", "y", "z", "x") in {n for n, _ in got}
    assert simple < {n for n, _ in got}


@pytest.mark.parametrize("limit", [1, 3, 7, 1000])
def test_preorder_is_that_of_a_walk(spark, limit):
    rng = random.Random(limit)
    edges = [(f"{k:03d}", rng.choice("AB"), rng.choice("abcdefg"), rng.choice("abcdefg")) for k in range(25)]
    e = spark.createDataFrame(edges, "id string, type string, source string, target string")
    roots = spark.createDataFrame([("a",), ("b",), ("nowhere",)], "node string")
    got = paths.preorder_paths(e, roots, 3, limit).collect()
    for root in "ab":
        mine = [tuple(r.nodes) for r in sorted(got, key=lambda r: r.place) if r.root == root]
        assert mine == [n for n, _ in plain_trails(edges, root, 3, simple=True)][:limit]
    assert {r.root for r in got} <= {"a", "b"}


def test_a_hub_makes_no_more_rows_than_the_limit_allows(spark, monkeypatch):
    """A hub of 10,000 edges, reached from a root by many parallel edges: no level writes more than the limit for a root."""
    edges = spark.range(10_000).select(F.format_string("h%06d", "id").alias("id"), F.lit("A").alias("type"), F.lit("hub").alias("source"), F.format_string("n%06d", "id").alias("target"))
    more = spark.range(3_000).select(F.format_string("p%06d", "id").alias("id"), F.lit("A").alias("type"), F.lit("root").alias("source"), F.lit("hub").alias("target"))
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(paths, "written", counted)
    got = paths.preorder_paths(edges.unionByName(more), spark.sql("SELECT 'root' AS node UNION ALL SELECT 'n000005'"), 3, 100)
    assert got.groupBy("root").count().count() == 2 and got.count() == 200
    assert max(sizes["preorder"]) <= 200 and sizes["first-edges"][0] <= 100 + 400 + 10_000
    first = [r.nodes for r in got.where("root = 'root'").orderBy("place").collect()]
    assert first[0] == ["root", "hub"] and first[1] == ["root", "hub", "n000000"]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_batches_touch_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = lambda ks, v: spark.createDataFrame([(k, v, k * 2) for k in ks], "k long, v string, w long")
    keyed.upsert(rows(range(500), "old"), path, ["k"], parts=16)
    before = files(path)
    few = rows([3, 700], "new")
    hit = set(keyed.touched(few.withColumn("key_part", keyed.part_of(["k"], 16))))
    time.sleep(0.01)
    keyed.upsert(few, path, ["k"], parts=16)
    after = files(path)
    part = lambda f: int(f.split("key_part=")[1].split("/")[0])
    assert {f: t for f, t in before.items() if part(f) not in hit} == {f: t for f, t in after.items() if part(f) not in hit}
    assert len(hit) <= 2 and all(f not in after for f in before if part(f) in hit)
    got = {r.k: r.v for r in keyed.rows(spark, path).collect()}
    assert got == {k: "old" for k in range(500)} | {3: "new", 700: "new"}
    plan = keyed.partitions(spark, path, sorted(hit))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [key_part" in plan
    read = {part(r[0]) for r in keyed.partitions(spark, path, sorted(hit)).select(F.input_file_name()).distinct().collect()}
    assert read == hit


def test_the_filter_tells_new_keys_without_reading_the_table(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "keyed"), []
    real = keyed.partitions
    monkeypatch.setattr(keyed, "partitions", lambda s, p, parts: asked.append(parts) or real(s, p, parts))
    batch = lambda ks: spark.createDataFrame([(k, k % 3) for k in ks], "k long, v long")
    assert keyed.ingest(batch(range(0, 2000)), path, ["k"], parts=8).count() == 2000
    assert keyed.ingest(batch(range(5000, 5050)), path, ["k"], parts=8).count() == 50
    assert asked[-1] == []  # every key is ruled out
    assert keyed.ingest(batch([1, 1, 9999, 5001]), path, ["k"], parts=8).count() == 1
    assert 0 < len(asked[-1]) <= 2
    assert keyed.ingest(batch([1, 9999]), path, ["k"], parts=8).count() == 0  # a batch that is run again
    assert sorted(r.k for r in keyed.rows(spark, path).collect()) == [*range(2000), *range(5000, 5050), 9999]


def test_a_table_without_filters_gets_them(spark, tmp_path):
    path = str(tmp_path / "keyed")
    spark.range(100).select(F.col("id").alias("k"), keyed.part_of(["id"], 4).alias("key_part")).write.partitionBy("key_part").parquet(path)
    batch = lambda ks: spark.createDataFrame([(k,) for k in ks], "k long")
    assert keyed.ingest(batch([5, 200]), path, ["k"], parts=4).count() == 1
    assert keyed.ingest(batch([*range(100), 200, 201]), path, ["k"], parts=4).count() == 1
    keyed.upsert(batch([]), path, ["k"], parts=4)
    assert sorted(r.k for r in keyed.rows(spark, path).collect()) == [*range(100), 200, 201]


def test_a_filter_holds_every_key_and_few_others(spark):
    held = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("key_part"))
    filters = written(keyed.key_filter(held, ["k"]), "filter")
    asked = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).alias("key_part"))
    got = keyed.maybe_kept(asked, filters, ["k"]).groupBy((F.col("k") < 4000).alias("held")).agg(F.count_if("maybe").alias("n")).collect()
    n = {r.held: r.n for r in got}
    assert n[True] == 4000 and n[False] < 160


def plain_grams(ws):
    return {f"  {w} "[i : i + 3] for w in ws for i in range(len(w) + 1)}


def plain_score(name, search):
    a, b = name.split(), search.split()
    n = len(a)
    share = max(len(plain_grams(a) & plain_grams(b[i : i + n])) for i in range(max(len(b) - n, 0) + 1)) / len(plain_grams(a))
    return max([100.0] * (name == search) + [80.0] * (name in search) + [50 * share] * (share >= 0.6), default=None)


def test_trigrams_miss_no_name(spark):
    rng = random.Random(11)
    syllables = ["ta", "wan", "chi", "le", "ber", "lin", "x", "os", "lo", "ü"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    all_names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(250)} | {"x", "lo", "ta"})
    searches = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)} | set(rng.sample(all_names, 20)) | {"", "  "})
    got = names.near_names(spark.createDataFrame([(n,) for n in all_names], "name string"), spark.createDataFrame([(s,) for s in searches], "search string")).collect()
    want = {(s, n): plain_score(n, s) for s in searches for n in all_names if plain_score(n, s) is not None}
    assert {(r.search, r.name): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) > 100


def test_matching_nodes(spark):
    nodes = spark.createDataFrame([("1", "Taiwan"), ("2", "Made in Taiwan"), ("3", "Taiwam"), ("4", "Chile"), ("5", None), ("6", " ")], "id string, name string")
    ask = lambda df, q: [(r.id, r.score) for r in names.match_nodes(df, spark.createDataFrame([(q,), (None,)], "search string")).orderBy("rank").collect()]
    assert ask(nodes, "taiwan")[0] == ("1", 100.0)
    assert ask(nodes, "The Taiwan strait")[0] == ("1", 80.0)
    assert ("2", round(20 * 2 / 3, 6)) in ask(nodes.withColumn("text", F.lower("name")), "in made")
    many = spark.range(300).select(F.format_string("n%04d", "id").alias("id"), F.lit("Same Name").alias("name"))
    assert ask(many, "same name") == [(f"n{k:04d}", 100.0) for k in range(20)]


def test_phrases_and_covers(spark):
    docs = spark.createDataFrame([(1, "a b a b a c"), (2, "b a c a"), (3, None), (4, "A, b! a"), (5, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "a b a"), (2, "c a b"), (3, ""), (4, None), (5, "a zzz"), (6, "a")], "item_id int, text string")
    got = {(r.item_id, r.doc_id): (r.first, r.matches) for r in positions.phrase_matches(docs, asked).collect()}
    assert got == {(1, 1): (0, 2), (1, 4): (0, 1), (6, 1): (0, 3), (6, 2): (1, 2), (6, 4): (0, 2)}
    covers = {(r.item_id, r.doc_id): (r.covers, r.shortest, r.score) for r in positions.cover_ranks(docs, asked).collect()}
    assert covers[(1, 1)] == (4, 2, 2.0) and covers[(2, 2)] == (1, 3, round(1 / 3, 6)) and covers[(2, 1)] == (1, 3, round(1 / 3, 6))
    assert (5, 1) not in covers and covers[(6, 1)] == (3, 1, 3.0)


def test_common_terms_are_not_shuffled(spark):
    """Only the rarest term of a search leaves the documents with its places."""
    docs = spark.range(300).select("id", F.concat(F.repeat(F.lit("the of "), 50), F.when(F.col("id") == 7, "needle the").otherwise("hay")).alias("text")).withColumnRenamed("id", "doc_id")
    rare = positions.rarest_terms(docs, spark.createDataFrame([(1, "the needle the of")], "item_id int, text string"), "item_id")
    assert [(r.term, r.offset) for r in rare.collect()] == [("needle", 1)]
    assert positions.postings(docs, rare.select("term")).count() == 1


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = numbered(df, [F.desc("g"), "k"], "n", first=0).collect()
    want = sorted(((r.g, r.k) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.g, r.k) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(5000))
    assert numbered(df.where("false"), ["k"]).count() == 0


def test_personal_keys_by_value_not_by_text(spark):
    given = [(1, r'{"email": 1}'), (2, r'{"note": "\"email\": 1"}'), (3, '[[{"x": [{"Full Name": null}]}]]'), (4, "nope"), (5, None), (6, '"email"'), (7, '{"a": {"a": {"a": {"a": {"e-mail": []}}}}}')]
    rows = spark.createDataFrame(given, "id int, body string")
    assert {r.id: r.personal for r in ontology.personal_keys(rows, "id", "body").collect()} == {1: ["email"], 2: [], 3: ["fullname"], 4: [], 5: [], 6: [], 7: ["email"]}
    assert len(list(variant.levels(rows, "id", "body"))) == 6


def test_schemas_are_checked_at_every_depth(spark):
    inner = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "maximum": 9}, "d": {"type": "string", "format": "date"}}}
    schema = {"type": "object", "minProperties": 1, "additionalProperties": False, "properties": {"in": inner, "list": {"type": "array"}, "odd'key": {"type": "boolean"}, "e": {"enum": ["a", 1, None]}, "u": {"format": "uuid"}, "t": {"format": "date-time"}}}
    given = [
        {"in": {"n": 3, "d": "2024-02-29"}}, {"in": {"n": 3.5}}, {"in": {"n": 12.0, "d": "2024-02-30"}}, {"in": {"d": 5}}, {}, {"in": None, "odd'key": 1}, {"odd'key": True, "x": 1}, {"list": {}}, {"e": "b"}, {"e": 1.0}, {"e": "1"}, {"u": "x"},
        {"t": "2024-01-01T10:00:00Z"}, {"t": "soon"}, [1], 5, {"in": {"n": True}},
    ]
    rows = spark.createDataFrame([(str(i), json.dumps(g)) for i, g in enumerate(given)] + [("bad", "{"), ("twice", '{"e": "a", "e": "a"}')], "id string, payload string")
    want = {
        "1": ["$.in.n must be integer"], "2": ["$.in.n must be at most 9", "$.in.d is no date"], "3": ["$.in.n is required", "$.in.d must be string"], "4": ["$ has too few properties"], "5": ["$.odd'key must be boolean"], "6": ["$.x is not allowed"],
        "7": ["$.list must be array"], "8": ["$.e is not one of the allowed values"], "10": ["$.e is not one of the allowed values"], "11": ["$.u is no uuid"], "13": ["$.t is no date-time"], "14": ["$ must be object"], "15": ["$ must be object"],
        "16": ["$.in.n must be integer"], "bad": ["$ is no JSON"], "twice": ["$ is no JSON"],
    }
    assert {r.id: r.faults for r in ontology.schema_violations(rows, schema).collect()} == want


def test_a_stream_that_stops_goes_on_where_it_was(spark, tmp_path):
    """Turns given out over several starts are those of one run; a change that comes too late changes nothing."""
    nodes = spark.createDataFrame([(1, "a", "SUPPLY", 10.0), (1, "b", "SUPPLY", 4.0), (2, "a", "SUPPLY", 1.0)], "branch int, entity string, metric string, value double")
    changed = spark.createDataFrame([(1, "a", "SUPPLY", 2, -0.5), (1, "b", "SUPPLY", 3, -2.0), (2, "a", "SUPPLY", 1, 0.25)], "branch int, entity string, metric string, turn int, change double")
    all_events = written(turns.turn_events(nodes, changed, 3), "events")
    late = all_events.where("change = 0.25").withColumn("change", F.lit(9.0))
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for batch in (all_events.where("turn = 1"), all_events.where("turn = 2"), all_events.where("turn = 3"), late, all_events.where("turn = 4")):
        batch.coalesce(1).write.mode("append").parquet(folder)
        turns.run_turns(spark, folder, target, checkpoint, 3).awaitTermination()
    got = {(r.branch, r.entity, r.turn): (r.value, r.affected) for r in spark.read.schema(turns.STATE).parquet(target).collect()}
    assert got == {
        (1, "a", 1): (10.0, False), (1, "a", 2): (5.0, True), (1, "a", 3): (5.0, False), (1, "b", 1): (4.0, False), (1, "b", 2): (4.0, False), (1, "b", 3): (0.0, True),
        (2, "a", 1): (1.25, True), (2, "a", 2): (1.25, False), (2, "a", 3): (1.25, False),
    }
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_ingestion_that_stops_goes_on(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select(*(c.split()[0] for c in events.EVENT.split(", ")))
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for some in ("event_id < 300", "event_id between 200 and 600", "event_id > 500"):
        e.where(some).write.mode("append").parquet(folder)
        events.ingest_stream(events.stream(spark, folder), target, checkpoint).awaitTermination()
    assert keyed.rows(spark, target).count() == e.select("event_type", "user_id", "props").distinct().count()


def test_written_tables_can_be_cleaned_up(spark, tmp_path, monkeypatch):
    from tradeloom.plans import storage

    (tmp_path / "mine").mkdir()
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    kept = storage.written(spark.range(5), "some")
    assert storage.exists(spark, kept._tradeloom_path) and kept.count() == 5
    assert storage.clean(spark) == 1 and storage.clean(spark) == 0
    assert not storage.exists(spark, kept._tradeloom_path) and sorted(os.listdir(tmp_path)) == ["mine"]


def test_small_tables_are_told_without_running_them(spark, tmp_path):
    """Nothing runs to find out how large a table is, and a table beyond the bound is not dealt out."""
    from tradeloom.plans import storage

    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    df = spark.range(1000).mapInPandas(counted, "id long").groupBy("id").count()
    small = storage.spread(df)
    assert ran.value == 0
    assert small.count() == 1000
    path = str(tmp_path / "wide")
    spark.range(300).select(F.expr("cast(repeat(cast(rand() as string), 2) as string)").alias("t")).write.parquet(path)
    wide = spark.read.parquet(path)
    old, storage.SMALL_BYTES = storage.SMALL_BYTES, 100
    try:
        assert "Exchange" not in storage.spread(wide)._jdf.queryExecution().executedPlan().toString()
    finally:
        storage.SMALL_BYTES = old
    assert "Exchange" in storage.spread(wide)._jdf.queryExecution().executedPlan().toString()
