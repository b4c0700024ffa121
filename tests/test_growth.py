"""Tables with many copies: the work grows with the rows, not with their pairs, and the results are those of plain loops."""

import random
import threading

from pyspark.sql import functions as F

from tradeloom.operators import joins, resolve


def timed(spark, seconds, f):
    """What ``f`` gives; its jobs are cancelled, so that it fails, once it takes longer."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


def test_single_similar_among_copies(spark):
    rng = random.Random(5)
    left, right = ([(rng.randrange(60), "".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))), rng.randrange(4)) for _ in range(90)] for _ in "lr")
    schema = "id long, name string, block int"
    for a, b in ((left, right), (left, left)):
        got = joins.single_similar(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["block"], 0.75).collect()
        want = []
        for i in {x[0] for x in a}:
            hits = [(y[0], round(alike(x[1], y[1]), 6)) for x in a if x[0] == i for y in b if x[2] == y[2] and x[0] != y[0] and alike(x[1], y[1]) >= 0.75]
            want += [(i, *hits[0])] if len(hits) == 1 else []
        assert sorted(map(tuple, got)) == sorted(want) and want


def test_single_similar_of_one_large_block(spark):
    n = spark.range(60000).select("id", F.lit("dark copper bolt").alias("name"), F.lit(1).alias("block"))
    n = n.union(spark.createDataFrame([(70000, "pale silver ring", 1), (70001, "pale silver rings", 1)], n.schema))
    assert sorted((r[0], r[1]) for r in timed(spark, 60, joins.single_similar(n, n, ["block"], 0.75).collect)) == [(70000, 70001), (70001, 70000)]


def test_match_keys_by_sets(spark):
    rng = random.Random(6)
    keys = [(rng.choice(["LEI", "lei ", "natural-key", None]), rng.choice(["a", " A", "b", "c", None])) for _ in range(60)]
    asked, known = ([(rng.randrange(25), rng.choice(["C", "D", None]), *rng.choice(keys)) for _ in range(70)] for _ in "ak")
    got = resolve.match_keys(spark.createDataFrame(asked, "candidate long, entity_type string, scheme string, value string"), spark.createDataFrame(known, "entity_id long, entity_type string, scheme string, value string")).collect()
    plain = lambda r: None if None in r[1:] else (r[1], r[2].strip().upper().replace("-", "_"), r[3].strip().lower())
    want = []
    for c in {r[0] for r in asked}:
        hit = {k[0] for k in known for r in asked if r[0] == c and plain(r) and plain(r) == plain(k)}
        want.append((c, len(hit), min(hit) if len(hit) == 1 else None, ["NEW", "MATCHED", "CONFLICT"][min(len(hit), 2)]))
    assert sorted(map(tuple, got)) == sorted(want) and len({w[3] for w in want}) == 3


def test_match_keys_of_one_common_key(spark):
    asked = spark.range(40000).select(F.col("id").alias("candidate"), F.lit("C").alias("entity_type"), F.lit("LEI").alias("scheme"), F.lit("x").alias("value"))
    got = timed(spark, 60, resolve.match_keys(asked, asked.withColumnRenamed("candidate", "entity_id")).groupBy("matches", "status").count().collect)
    assert [tuple(r) for r in got] == [(40000, "CONFLICT", 40000)]


def test_match_names_among_copies(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(2, 8)))
    asked, known = ([(rng.randrange(50), rng.choice("TU"), name()) for _ in range(80)] for _ in "ak")
    got = resolve.match_names(spark.createDataFrame(asked, "candidate long, entity_type string, name string"), spark.createDataFrame(known, "entity_id long, entity_type string, name string"), 0.8).collect()
    want = []
    for c in {r[0] for r in asked}:
        hits = [(k[0], alike(r[2], k[2])) for r in asked if r[0] == c and len(r[2]) >= 3 for k in known if k[1] == r[1] and len(k[2]) >= 3 and alike(r[2], k[2]) >= 0.8]
        same, near = {h[0] for h in hits if h[1] == 1}, {h[0] for h in hits}
        if len(same) == 1 or (not same and len(near) == 1):
            want.append((c, *(same or near), max(h[1] for h in hits)))
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_match_names_of_one_common_name(spark):
    asked = spark.range(20000).select(F.col("id").alias("candidate"), F.lit("T").alias("entity_type"), F.lit("amber glass holding of the north").alias("name"))
    assert timed(spark, 60, resolve.match_names(asked, asked.withColumnRenamed("candidate", "entity_id")).count) == 0


def test_batches_of_pages_are_bounded_by_bytes(spark):
    from tradeloom.sources import payloads

    pages = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 200_000).cast("binary").alias("content"), F.lit(None).cast("string").alias("content_encoding"), F.lit("v").alias("source_version"), F.col("id").cast("int").alias("page_number"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    seen = {}
    run, plain = type(pages).mapInPandas, payloads.text

    def counting(self, f, schema):
        def each(batches):
            return f(b for b in batches if len(b) * 200_000 <= 2 * (8 << 20) or 1 / 0)

        seen["used"] = True
        return run(self, each, schema)

    type(pages).mapInPandas = counting
    try:
        j = payloads.json_pages(pages)
    finally:
        type(pages).mapInPandas = run
    assert seen and j.count() == 300


def test_batches_of_texts_are_bounded_by_bytes(spark, monkeypatch):
    from tradeloom.operators import retrieval

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("x"), 200_000)).alias("text"))
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    monkeypatch.setattr(retrieval, "spread", lambda df: df)
    run = type(docs).mapInPandas

    def counting(self, f, schema):
        return run(self, lambda batches: f(b for b in batches if len(b) * 200_000 <= 2 * (8 << 20) or 1 / 0), schema)

    monkeypatch.setattr(type(docs), "mapInPandas", counting)
    for f, n in ((lambda: retrieval.keyword_top(docs, asked, "doc_id", "item_id", 10), 10), (lambda: retrieval.hashing_embedding(docs, "doc_id", "text"), 400), (lambda: retrieval.chunks(docs).select("doc_id").distinct(), 400)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert f().count() == n


def test_few_searches_go_to_the_vectors(spark, monkeypatch):
    from tradeloom.operators import retrieval

    rng = random.Random(8)
    rows = spark.createDataFrame([(i, [float(rng.randrange(-2, 3)) for _ in range(3)] + [0.5]) for i in range(900)], "vec_id long, embedding array<double>").repartition(5)
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 200)
    ways = []
    for sent in (4096, 0):
        monkeypatch.setattr(retrieval, "SENT_VECTORS", sent)
        ways.append([sorted(map(tuple, retrieval.nearest(rows, asked, 7, own).collect())) for own in (False, True)])
    assert ways[0] == ways[1] and len(ways[0][0]) == 7 * 18
    monkeypatch.setattr(retrieval, "SENT_VECTORS", 4096)
    monkeypatch.setattr(retrieval, "CELLS", 40)  # the best so far are cut to k often
    assert [sorted(map(tuple, retrieval.nearest(rows, asked, 7, own).collect())) for own in (False, True)] == ways[0]
    monkeypatch.setattr(retrieval, "written", None)  # no vectors are written or dealt out
    assert retrieval.nearest(rows, asked, 7).count() == 7 * 18


def test_pages_of_filings_and_facts_are_read_once(spark, small):
    import json

    from tradeloom.sources import adapters, given

    plan = given.source_sec_facts(spark, small)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("MapInPandas") == 1 and plan.count("hashpartitioning") == 1, plan
    recent = {"accessionNumber": ["n1", "n2"], "filingDate": ["2020-01-02", "202003"], "form": ["8-K"], "reportDate": [], "primaryDocument": []}
    facts = {"us-gaap": {"A": {"label": "la", "units": {"USD": [{"val": "1,000", "end": "2020-05-06", "accn": "x"}, None, {"val": "b"}], "m2": []}}, "B": {"label": "lb", "units": {}}}, "none": {}}
    both = {"cik": "7", "name": "N", "entityName": "E", "filings": {"recent": recent}, "facts": facts}
    bodies = [json.dumps(both), json.dumps({"cik": "8", "facts": facts}).replace('"facts"', '"f\\u0061cts"'), '{"cik": "9", "filings": {"recent": {"accessionNumber": []}}}', '{"cik": "9", "facts": null}', "no json facts filings"]
    pages = spark.createDataFrame([(b.encode(), None, "v", i) for i, b in enumerate(bodies)], "content binary, content_encoding string, source_version string, page_number int")
    got = sorted((r.page_number, r.record_type, r.natural_key or "", str(r.period_start), r.value or "", r.dimensions) for r in adapters.sec(pages).collect())
    fact = lambda page, cik, entity: [
        (page, "SEC_XBRL_FACT", f"{cik}:us-gaap:A:USD:null:null:null:null", "None", None, entity), (page, "SEC_XBRL_FACT", f"{cik}:us-gaap:A:USD:null:null:null:null", "None", '{"text":"b"}', entity),
        (page, "SEC_XBRL_FACT", f"{cik}:us-gaap:A:USD:x:null:2020-05-06:null", "2020-05-06", "1000", entity),
    ]
    assert [x[:4] for x in got] == [(0, "SEC_FILING", "7:n1", "2020-01-02"), (0, "SEC_FILING", "7:n2", "2020-03-01")] + [x[:4] for x in fact(0, "7", {}) + fact(1, "8", {})]
    assert got[0][5] == {"cik": "7", "companyName": "N"} and got[4][5] == {"cik": "7", "entityName": "E", "label": "la"} and got[7][5] == {"cik": "8", "label": "la"} and got[4][4] == "1000"


def test_a_batch_meets_only_its_own_keys_of_the_table(spark, tmp_path, monkeypatch):
    from tradeloom.operators import keyed

    path, batch = f"file://{tmp_path}/kept", lambda ids: spark.createDataFrame([(i, i % 7) for i in ids], "k long, v long")
    assert keyed.ingest(spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), path, ["k"]).count() == 20_000
    met, run = [], type(spark.range(0)).join

    def counting(self, other, on=None, how=None):
        if how == "left_anti":
            met.append(other.count())
        return run(self, other, on, how)

    monkeypatch.setattr(type(spark.range(0)), "join", counting)
    assert keyed.ingest(batch(range(19_000, 21_000)), path, ["k"]).count() == 1000
    assert met and 1000 <= met[0] < 3000
    assert keyed.ingest(batch([1, 1, 20_999, 30_000]), path, ["k"]).count() == 1 and met[1] < 100
    assert keyed.rows(spark, path).count() == 21_001 == keyed.rows(spark, path).distinct().count()


def test_pages_are_files_of_one_folder(spark, tmp_path):
    import os

    import duckdb

    import __spark_entry__ as entry
    from tradeloom.plans.storage import shared_folder

    rows = [(i * 7 - 30, t, None if (i + t) % 9 == 0 else f"é {i}\n{t}") for i in range(120) for t in range(i % 4 + 1)] + [(33, None, "last"), (None, 0, "no"), (None, 1, "id")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    kept = lambda: {f for f in os.listdir(shared_folder(spark)[7:]) if f.startswith("tradeloom-pages-")}
    before = kept()
    got = sorted(map(tuple, entry.queries()["source_page_files"](spark, f"file://{tmp_path}").select("page_number", "body").collect()))
    d = duckdb.connect()
    d.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(d.execute(entry.oracle_sql()["source_page_files"]).fetchall()) and len(got) == 121
    (folder,) = kept() - before
    # A file for each page and nothing else: no folders to make and to list, no sums beside.
    assert [len(x) for x in list(os.walk(f"{shared_folder(spark)[7:]}/{folder}"))[0][1:]] == [0, 121]


def test_pages_are_the_same_in_another_store(spark, tmp_path):
    import os

    from tradeloom.sources import payloads

    rows = [(k, f"{i}") for k in ["1", "10", "2", "a/b:c%", "é", None] for i in range(3)]
    lines = spark.createDataFrame(rows, "k string, line string").coalesce(1)
    os.mkdir(f"{tmp_path}/store")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pages.link./t", f"file://{tmp_path}/store")
    for folder in (f"file://{tmp_path}/own", f"file://{tmp_path}/own", "viewfs://pages/t/own"):  # what is written again takes the same place
        payloads.write_page_files(lines, folder)
        got = sorted((r.page_number, bytes(r.content)) for r in payloads.page_files(spark, folder, "1").collect())
        assert got == [(i, b"0\n1\n2\n") for i in range(1, 7)]
    assert sorted(os.listdir(f"{tmp_path}/own")) == sorted(f for f in os.listdir(f"{tmp_path}/store/own") if f.startswith("k="))
