import json

from pyspark.sql import functions as F

from roleweave.operators.dedup import deduplicate_postings
from roleweave.operators.skills import SkillExtractor
from roleweave.plans import matching as N
from roleweave.sources import postings as P
from roleweave.sources import sinks
from roleweave.streaming import ingest as I


def _posting(title, **more):
    named = {"company": {"display_name": " Acme  Co "}, "location": {"display_name": "X"}, "category": {"label": "IT"}}
    return {"title": title, "description": "Python and SQL", "redirect_url": "http://a", **named, **more}


def _land(folder, pages):
    for number, results in pages.items():
        (folder / f"page_{number}.json").write_text(json.dumps({"results": results}))
    return str(folder)


def test_landed_pages(spark, tmp_path, vocab):
    pages = {
        1: [_posting("One", salary_min=10.5), _posting(" Two ", company="plain", category=None)],
        3: [_posting("Three", location=7, contract_time=" full_time ")],  # page 2 failed
        4: [],
        5: [_posting("Five")],
        13: [_posting("Late")],
    }
    usable = P.usable_pages(P.read_api_pages(spark, _land(tmp_path, pages)))
    rows = P.flatten_pages(usable).orderBy("arrival_seq").collect()
    assert [r["job_title"] for r in rows] == ["One", "Two", "Three"]
    assert [r["company"] for r in rows] == ["Acme Co", "", "Acme Co"]
    assert [r["category"] for r in rows] == ["IT", "", "IT"]
    assert (rows[2]["job_location"], rows[2]["contract_time"], rows[2]["source_page"]) == ("", "full_time", 3)
    assert (rows[0]["salary_min"], rows[1]["salary_min"]) == (10.5, None)
    full = P.with_skills(P.flatten_pages(usable), SkillExtractor(spark, vocab)).orderBy("arrival_seq").first()
    assert (full["job_skills_list"], full["job_skills"]) == (["python", "sql"], "python, sql")
    assert full["job_text"] == "One | Python and SQL | python, sql | Acme Co | X"


def test_reduced_landing_parts_whole_and_rejected(spark, tmp_path):
    rows = [_posting("One"), _posting("Two", company=None), _posting("Three", location="plain"), _posting("Four", company={"display_name": None}), None]
    reduced = P.flatten_reduced(P.read_api_pages(spark, _land(tmp_path, {1: rows})))
    good = P.accepted(reduced).collect()
    assert [(r["job_title"], r["company"], r["job_skills"]) for r in good] == [("One", " Acme  Co ", "")]
    assert good[0].asDict().keys() == set(P.REDUCED_COLUMNS)
    bad = {r["pos"]: (r["job_title"], r["reason"]) for r in P.rejected(reduced).collect()}
    assert bad == {
        1: ("Two", "company without display_name"), 2: ("Three", "location without display_name"),
        3: ("Four", "company without display_name"), 4: (None, "posting is null"),
    }


def test_searches_that_begin_alike_keep_their_own_order(spark):
    names = ["data-scientist-us", "data-scientist-uk", "data-scientist-fr", "1", "01", "a/b", "a%2Fb", None]
    posting = "title string, company string, location string, description string, redirect_url string, category string, contract_type string, contract_time string, salary_min double, salary_max double"
    one = ("Dev", '{"display_name": "A"}', '{"display_name": "X"}', "text", None, None, None, None, None, None)
    rows = [(n, p, [(*one[:4], f"u{i}", *one[5:])] if n != "data-scientist-uk" else [(*one[:4], "u0", *one[5:])]) for i, n in enumerate(names) for p in (1, 2)]
    pages = spark.createDataFrame(rows, f"search string, page int, results array<struct<{posting.replace(' string', ': string').replace(' double', ': double')}>>")
    flat = P.flatten_pages(pages, keep=("search",))
    ids = [r["posting_id"] for r in flat.collect()]
    assert len(set(ids)) == len(rows) and any(i.startswith("data-scientist-us/") for i in ids)
    kept = deduplicate_postings(flat.where("search LIKE 'data%' AND page = 1").withColumn("job_title", F.col("job_link"))).collect()
    assert sorted(r["search"] for r in kept) == ["data-scientist-fr", "data-scientist-uk"]


def test_resumes_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe SQL\n\tGo ")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [r["resume_text"] for r in P.read_resumes(spark, str(tmp_path)).collect()] == ["café SQL Go"]


CSV = '''job_link,job_title,company,job_location,first_seen,job_level,job_type,job_summary,job_skills
u1,"Data, ""Lead""",A,X,2024-01-02,,,"two
lines","SQL, Go ,sql"
u1,Copy,A,X,bad date,,,x,Go
u2, ,A,X,,,,x,Go
u3,Ops,A,X,soon,,,y,
u4,Dev,B,X,soon,,,z,"go,, c++"
'''


def test_clean_and_match_csv(spark, tmp_path, vocab):
    (tmp_path / "p.csv").write_text(CSV)
    raw = P.read_posting_csv(spark, str(tmp_path / "p.csv")).withColumn("arrival_seq", F.monotonically_increasing_id())
    clean = N.clean_postings(raw)
    rows = {r["job_link"]: r for r in clean.collect()}
    assert sorted(rows) == ["u1", "u4"]
    assert rows["u1"]["job_title"] == 'Data, "Lead"'
    assert rows["u1"]["job_text"] == 'Data, "Lead" two lines SQL, Go ,sql'
    assert rows["u1"]["job_skills_list"] == ["sql", "go", "sql"]
    assert rows["u4"]["first_seen"] is None and rows["u1"]["first_seen"].year == 2024
    matched = {r["job_link"]: r for r in N.match_skills(clean, ["SQL "]).collect()}
    assert (matched["u1"]["skill_score"], matched["u1"]["missing_skills"]) == (0.5, ["go"])
    texts = N.match_text(clean, "a dev with go", vocab)
    assert N.best(clean.join(texts, "arrival_seq"), "similarity", 1).first()["job_link"] == "u4"


def test_csv_files_have_one_order(spark, tmp_path):
    head = "job_link,job_title,company,job_location,first_seen,job_level,job_type,job_summary,job_skills\n"
    for name in ("b.csv", "a.csv"):
        rows = "".join(f'{name}{i},t,c,l,,,,"two\nlines, ""{i}""",s\n' for i in range(30))
        (tmp_path / name).write_text(head + rows)
    rows = P.read_posting_csv_in_order(spark, str(tmp_path)).orderBy("arrival_seq").collect()
    assert [r["job_link"] for r in rows] == [f"{n}{i}" for n in ("a.csv", "b.csv") for i in range(30)]
    assert len({r["arrival_seq"] for r in rows}) == 60 and rows[3]["job_summary"] == 'two\nlines, "3"'


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, ["x", "y"], 2), ('a "q"', 0.9, [], 1)], "job_title string, final_score double, extra array<string>, n int")
    sinks.write_csv(df, str(tmp_path / "all"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "all")).orderBy("n").collect()
    assert [(r["job_title"], r["extra"]) for r in back] == [('a "q"', "[]"), ("b", '["x","y"]')]
    assert sinks.export_columns(df).columns == ["job_title", "final_score"]
    sinks.write_ranked(df, str(tmp_path / "ranked"), [F.col("final_score").desc()])
    lines = [x for f in sorted((tmp_path / "ranked").glob("*.csv")) for x in f.read_text().splitlines()[1:]]
    assert [x.rsplit(",", 1)[1] for x in lines] == ["0.9", "0.5"]


POSTINGS = [
    [(1, "Dev", "A", "u1"), (2, "Ops", "A", "u2"), (3, "Dev", "A", "u3")],
    [(4, "Dev", "B", "u3"), (5, "QA", "A", "u1"), (6, "QA", "A", "")],
    [(7, "Ops", "A", "u9"), (8, "New", "C", "U2 "), (9, "New", "C", None), (10, "New", "C", "u10")],
]
SCHEMA = "arrival_seq long, job_title string, company string, job_link string"


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    for number, rows in enumerate(POSTINGS):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(landing / f"d={number}"))
    batch = spark.createDataFrame([r for rows in POSTINGS for r in rows], SCHEMA).withColumn("job_location", F.lit("X"))
    want = sorted(r["arrival_seq"] for r in deduplicate_postings(batch).collect())
    target = str(tmp_path / "table")
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(landing)).drop("d")
        .withColumn("job_location", F.lit("X"))
    )
    I.ingest(stream, target, str(tmp_path / "progress")).awaitTermination()
    got = I.read_ingested(spark, target)
    assert sorted(r["arrival_seq"] for r in got.collect()) == want
    # A replayed batch overwrites its own partitions.
    last = spark.createDataFrame(POSTINGS[2], SCHEMA).withColumn("job_location", F.lit("X"))
    I.dedup_sink(target)(last, 2)
    assert sorted(r["arrival_seq"] for r in I.read_ingested(spark, target).collect()) == want


def test_runs_hold_all_earlier_batches_and_a_batch_opens_its_buckets_only(spark, tmp_path):
    settings = I.KeySettings(merge_every=2, bucket_keys=4)
    schema = spark.range(0).selectExpr("cast(id as string) AS link_key").schema
    table = I.KeyTable(spark, str(tmp_path / "links"), schema, settings)
    for batch in range(7):
        if batch != 3:  # a batch may leave nothing
            table.add(spark.range(batch * 20, batch * 20 + 20).selectExpr("cast(id as string) AS link_key"), batch)
    everything = spark.range(140).selectExpr("cast(id as string) AS link_key")
    assert table.known(everything, 0) is None
    for batch in range(1, 8):
        want = {str(i) for b in range(batch) if b != 3 for i in range(b * 20, b * 20 + 20)}
        got = [r[0] for r in table.known(everything, batch).collect()]
        assert sorted(got) == sorted(want)
    assert [table._parts(n) for n in (0, 5, 6)] == [([], range(0)), ([(2, 0)], range(4, 5)), ([(2, 0), (1, 2)], range(6, 6))]
    one = spark.createDataFrame([("5",)], "link_key string")
    found = table.known(one, 4)
    assert found.where("link_key = '5'").count() == 1 and found.count() < 60 / 4
    files = found.select(F.input_file_name()).distinct().count()
    assert files == 1
    # A run without its note was cut off: it is written again.
    import shutil
    shutil.rmtree(tmp_path / "links_notes" / "level=2")
    assert table.known(everything, 4).count() == 60


def test_small_buckets_share_a_folder(spark, tmp_path):
    schema = spark.range(0).selectExpr("cast(id as string) AS link_key").schema
    table = I.KeyTable(spark, str(tmp_path / "links"), schema, I.KeySettings(merge_every=2, bucket_keys=4))
    for batch in range(2):
        table.add(spark.range(batch * 500, batch * 500 + 500).selectExpr("cast(id as string) AS link_key"), batch)
    one = spark.createDataFrame([("5",)], "link_key string")
    found = table.known(one, 2)
    assert found.where("link_key = '5'").count() == 1 and found.count() < 50
    assert len(list((tmp_path / "links_runs").rglob("*.parquet"))) <= 4


def test_runs_with_a_folder_per_bucket_are_still_read(spark, tmp_path):
    keys = spark.range(40).selectExpr("cast(id as string) AS link_key")
    table = I.KeyTable(spark, str(tmp_path / "links"), keys.schema, I.KeySettings(merge_every=2, bucket_keys=4))
    keys.withColumn("bucket", table._hash(16)).write.partitionBy("bucket").parquet(table._run_path(1, 0))
    spark.createDataFrame([(16,)], "of int").write.parquet(str(tmp_path / "links_notes" / "level=1" / "run=0"))
    one = spark.createDataFrame([("5",)], "link_key string")
    found = table.known(one, 2)
    assert found.where("link_key = '5'").count() == 1 and found.count() < 40
    assert table.known(keys, 2).count() == 40


def test_the_ingest_query_reads_a_file_or_a_folder(spark, tmp_path):
    from workload.ingest import s11

    rows = [(i, f"word{i % 5} and more", "src", "en", 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for name in ("folder", "file"):
        assert sorted(r["posting_id"] for r in s11(spark, str(tmp_path / name)).collect()) == [0, 1, 2, 3, 4]


def test_bounded_state_variant(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "u"), ("2024-01-01 00:10:00", "u"), ("2024-01-01 00:20:00", "v")]
    spark.createDataFrame(rows, "at string, job_link string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, job_link string").json(str(tmp_path / "in"))
    query = (
        I.recent_links_only(stream, "at", "1 hour").writeStream.format("memory").queryName("recent")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["job_link"] for r in spark.table("recent").collect()) == ["u", "v"]


def test_a_cut_off_page_is_skipped_and_an_empty_one_ends(spark, tmp_path):
    folder = tmp_path / "search-a"
    folder.mkdir()
    good = '{"results": [{"title": "t%d", "redirect_url": "u%d"}]}'
    for page, text in {1: good % (1, 1), 2: '{"results": [{"title": "cut', 3: good % (3, 3), 4: '{"other": 1}', 5: good % (5, 5)}.items():
        (folder / f"{page}.json").write_text(text)
    usable = P.usable_pages(P.read_api_pages(spark, str(tmp_path / "*")), "search")
    rows = P.flatten_pages(usable, keep=("search",)).orderBy("arrival_seq").collect()
    assert [(r["search"], r["source_page"], r["job_title"]) for r in rows] == [("search-a", 1, "t1"), ("search-a", 3, "t3")]
    assert len({r["posting_id"] for r in rows}) == 2


def test_pages_have_no_limit_by_default(spark):
    pages = spark.range(1, 31).selectExpr("cast(id as int) AS page", "array(named_struct('title', 't')) AS results")
    assert P.usable_pages(pages).count() == 30
    assert P.usable_pages(pages, max_pages=12).count() == 12
