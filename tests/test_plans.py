"""Sources, sinks, pipelines and streams on hand-made files."""

import hashlib
import json

import pytest
from harrow.functions.keys import primary_key, stable_key
from harrow.operators.quality import cascade, orphans, spec_rules, split_valid, well_formed
from harrow.plans.eligibility import check_eligibility, submission_pack
from harrow.plans.ingest import import_rows
from harrow.plans.merge import Policy, audit_history, merge_sources, with_keys
from harrow.plans.policies import POLICIES, SOURCE_KEYS
from harrow.session import conf_set, cut_lineage, measured_bytes, new_run_dir, shared_dir
from harrow.sources import readers, writers
from harrow.sources.schemas import (
    CANONICAL_DOCS,
    CANONICAL_PROGRAMS,
    OPPORTUNITY,
    PROGRAM_DOCS,
    PROGRAM_WITH_AMOUNT,
    PROGRAM_WITH_AMOUNT_SPEC,
    PROGRAMS,
)
from harrow.streaming import jobs
from harrow.vocab import ALL_SHEETS_HEADERS, TERRITORIES, TERRITORY_HEADERS
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_keyed_json_to_catalogue(spark, tmp_path):
    data = {
        "CA": [{"Subsidy Program": "A", "Link": "https://a"}, {"Program": " "}, {"Program": "B", "Subsidy Program": ""}],
        "XX": [{"Program": "dropped"}],
        "US": None,
    }
    path = tmp_path / "all.json"
    path.write_text(json.dumps(data))
    raw = readers.read_keyed_json(spark, str(path), TERRITORIES)
    headers = [h for hs in TERRITORY_HEADERS.values() for h in hs]
    wide = readers.columns_of_map(raw, headers)
    good, bad = import_rows(wide, TERRITORY_HEADERS, "2025-10-01", keep=["country", "source_sheet"])
    assert rows(good, "country", "source_sheet", "program_name", "hyperlink") == [("CA", "CA", "A", "https://a"), ("CA", "CA", "B", None)]
    assert bad.count() == 1 and good.columns == PROGRAMS.fieldNames()
    assert rows(good, "id") == rows(import_rows(wide, TERRITORY_HEADERS, "2026-01-01", keep=["country", "source_sheet"])[0], "id")


def test_csv_sheets(spark, tmp_path):
    (tmp_path / "CA.csv").write_text('Program Name,Description,Focus\nA,"two\nlines, here",\n,x,y\n')
    (tmp_path / "US.csv").write_text('Program Name,Description,Focus\n"B ""q""",,z\n')
    both = readers.read_sheets(spark, str(tmp_path))
    assert rows(both, "source_sheet", "Program Name") == [("CA", "A"), ("CA", None), ("US", 'B "q"')]
    one = readers.read_sheet(spark, str(tmp_path), "CA")
    good, bad = import_rows(one, ALL_SHEETS_HEADERS, "2025-10-01", keep=["source_sheet"], country="CA")
    assert rows(good, "program_name", "description", "focus") == [("A", "two\nlines, here", None)]
    assert rows(bad, "description", "failed_rules") == [("x", ["missing program_name"])]


def test_sheets_with_different_headers(spark, tmp_path):
    (tmp_path / "CA.csv").write_text("Subsidy Program,Deadlines\nA,soon\n")
    (tmp_path / "NZ.csv").write_text("Deadlines,Program,Focus\nlate,B,f\n")
    book = readers.read_workbook(spark, str(tmp_path), ["CA", "NZ"])
    good, _ = import_rows(book, TERRITORY_HEADERS, "2025-10-01", keep=["source_sheet"], country="X")
    assert rows(good, "source_sheet", "program_name", "focus") == [("CA", "A", None), ("NZ", "B", "f")]
    with pytest.raises(Exception):
        readers.read_sheets(spark, str(tmp_path)).collect()


def test_json_sheets_with_absent_and_null_cells(spark, tmp_path):
    (tmp_path / "S.json").write_text('{"a":"1","b":null}\n{"b":"2"}\n')
    df = readers.read_sheets(spark, str(tmp_path), "json", "a string, b string")
    assert rows(df, "a", "b", "source_sheet") == [("1", None, "S"), (None, "2", "S")]


def test_json_array(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"Subsidy Overview": f"line {i}"} for i in range(40)]))
    assert readers.read_rows_json(spark, str(path)).count() == 40


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_any_csv(spark, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_bytes(f'name{sep}note\r\nCafé{sep}"a\r\nb"\r\n'.encode())
    assert rows(readers.read_csv_any(spark, str(path)), "name", "note") == [("Café", "a\nb")]


def test_manifest_and_files(spark, tmp_path):
    manifest = tmp_path / "m.csv"
    manifest.write_text("program_id,program_title,province_or_state,country,doc_type,display_name,file_name,language,effective_date,source_url,notes\n,AgriInnovate,,Canada,guideline,Guide,g.pdf,en,,,\n")
    row = readers.read_manifest(spark, str(manifest)).first()
    assert row.program_id is None and row.file_name == "g.pdf"
    (tmp_path / "g.pdf").write_bytes(b"abc")
    (tmp_path / "n.txt").write_bytes(b"abc")
    hashes = readers.file_hashes(spark, str(tmp_path))
    assert rows(hashes, "file_name", "sha256") == [("g.pdf", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


def test_large_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "LARGE_FILE", 60)
    noise = bytes(i * i * 31 % 251 for i in range(5000))
    mark = b"\xef\xbb\xbf"
    files = {
        "a b%20.pdf": noise, "feed.pdf": noise + b"\n", "feeds.pdf": b"\n" * 70, "mark.pdf": mark + noise, "both.pdf": mark + noise + b"\n",
        "marks.pdf": mark + mark + noise, "odd.pdf": b"\xff\x00\r\n\r" * 30_000, "one.pdf": b"x" * 70, "only.pdf": mark * 21, "least.pdf": noise[:60],
        "[x].pdf": noise * 9, "gone.txt": noise,
    }
    (tmp_path / "sub" / "k=1").mkdir(parents=True)
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / ("sub/k=1" if i % 2 else "") / name).write_bytes(data)
    most = "spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes"
    with conf_set(spark, {most[0]: 60, most[1]: 1000}):
        hashes = readers.file_hashes(spark, str(tmp_path))
        got = rows(hashes, "file_name", "length", "sha256")
        assert spark.conf.get(most[1]) == "1000"
    assert sorted(got) == sorted((n, len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items() if n != "gone.txt")
    assert hashes.columns == ["path", "file_name", "length", "sha256"] and hashes.select("path").distinct().count() == 11


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><title>t</title><item><title>A &amp; B</title><link>https://x</link><guid>1</guid></item><item><title>C</title></item></channel></rss>")
    got = readers.read_feed_items(spark, str(tmp_path / "f.xml"))
    assert rows(got, "title", "link", "guid") == [("A & B", "https://x", "1"), ("C", None, None)]


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    writers.append_new(df, path, "id")
    writers.append_new(df.union(spark.createDataFrame([("c", 3)], "id string, v int")), path, "id")
    assert rows(spark.read.parquet(path), "id") == [("a",), ("b",), ("c",)]
    writers.append(df, path)
    assert spark.read.parquet(path).count() == 5


def test_nested_export_splits_large_programs(spark):
    programs = spark.createDataFrame([("p",), ("q",)], "id string")
    attrs = spark.createDataFrame([("p", "k", "2"), ("p", "k", "1")], "program_id string, attr_key string, attr_value string")
    docs = spark.createDataFrame([("p", str(i)) for i in range(100)], "program_id string, doc_id string")
    out = writers.export_nested(programs, attrs, docs, max_documents=10)
    got = out.filter("id = 'p'").collect()
    assert got[0].parts == 10 and all(r.attributes == {"k": "1"} for r in got)
    assert sorted(d.doc_id for r in got for d in r.documents) == sorted(str(i) for i in range(100))
    q = out.filter("id = 'q'").collect()
    assert len(q) == 1 and q[0].documents == [] and q[0].attributes == {}


def test_eligibility_and_pack(spark):
    forms = spark.createDataFrame(
        [(1, "John", "", "dairy", "1-50", "us-iowa", "soil-health", "own", "ID"), (2, None, None, "dairy", "", "canada-bc", "ipm", "", "")],
        "form_id int, farmer_name string, contact string, operation string, scale string, location string, practice string, land_control string, compliance_id string",
    )
    results = check_eligibility(forms)
    assert rows(results, "form_id", "eligible", "matched", "can_submit") == [(1, "likely", False, True), (2, "unclear", False, False)]
    keep = ["form_id", "program", "rule_type", "next_date", "cost_share", "cap", "eligible", "checklist"]
    pack = submission_pack(forms, results.select(*keep)).orderBy("form_id").collect()
    assert pack[0].contact == "Not provided" and pack[0].eligibility_details.cost_share == "50-75%"
    assert len(pack[0].checklist) == 3 and pack[1].program is None


def test_orphans_and_cascade(spark):
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, p string")
    parent = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(orphans(child, parent, "p", "key"), "id") == [(2,), (3,)]
    assert rows(cascade(child, parent, "p", "key"), "id") == [(1,)]


def test_merge_does_not_depend_on_order(spark):
    data = [
        ("a1", "gets_tender", "g1", "77", "Soil grant round one", "https://www.x.nz/t?id=77", 10, "tender"),
        ("a2", "gets_tender", "g1", "77", "Soil grant round 1", "https://www.x.nz/t?id=77", 20, "tender"),
        ("b1", "mpi_rss", "", "", "Minister opens round", "http://y.nz/news?ref=RFX77&utm_source=z", 30, "tender"),
        ("c1", "beehive_rss", "", "", "Dairy effluent rebate 2025", "https://z.nz/a", 40, "tender"),
        ("c2", "mpi_rss", "", "", "Dairy  Effluent rebate 2024", "https://z.nz/a/b", 50, "tender"),
        ("c3", "mpi_rss", "", "", "Dairy effluent rebate 2025", "https://z.nz/c", 60, "budget"),
        ("d1", "mpi_rss", "", "", None, None, None, "tender"),
        ("d2", "mpi_rss", "", "", None, None, None, "tender"),
    ]
    schema = "record_id string, source string, guid string, number string, title string, link string, sec long, kind string"
    policy = Policy(
        precedence=("gets_tender", "mpi_rss", "beehive_rss"),
        fields={"title": "latest_by_precedence", "link": "prefer_deepest_path"},
        id_pattern=r"RFX(\d+)",
        kinds={"kind": ""},
    )

    def run(order):
        df = spark.createDataFrame(order, schema).withColumn("published_at", F.timestamp_seconds("sec"))
        df = df.withColumn("key", primary_key(["guid"], {"link": "url", "title": "text"}, "record_id"))
        return rows(merge_sources([df.filter("source = 'mpi_rss'"), df.filter("source <> 'mpi_rss'")], policy), "*")

    got = run(data)
    assert got == run(data[::-1])
    assert [(r[0], r[1], r[2]) for r in got] == [
        ("a2", 2, "Soil grant round 1"), ("c1", 2, "Dairy  Effluent rebate 2024"),
        ("c3", 1, "Dairy effluent rebate 2025"), ("d1", 1, None), ("d2", 1, None),
    ]


def test_source_keys(spark):
    tender = spark.createDataFrame(
        [("1", "", "Soil  Works", "MPI", "2025", "2026", "https://www.gets.govt.nz/x?id=5"), ("2", "55", None, None, None, None, None)],
        "record_id string, RFx_ID string, title string, organisation string, Open_Date string, Close_Date string, detail_url string",
    )
    got = {r.record_id: r for r in with_keys(tender, SOURCE_KEYS["gets_tender"]).collect()}
    assert len(got["1"].key) == 40 and len(got["1"].second_key) == 40 and got["1"].link.endswith("id=5")
    assert got["2"].key == "55" and got["2"].second_key is None and got["2"].link is None


def test_chilean_policy_uses_its_own_source_order(spark):
    data = [
        ("1", "chilecompra", "k1", "7", "Riego", "https://www.fia.cl/a", "open", "call", "$1.000.000", 10),
        ("2", "fia_calls", "k2", "", "Riego", "https://fia.cl/b", "closed", "call", "$9", 20),
        ("3", "minagri_news", "k3", "", "Riego", "https://fia.cl/c", "news", "news", None, 5),
    ]
    df = spark.createDataFrame(data, "record_id string, source string, key string, number string, title string, link string, status string, record_type string, amount_local string, sec long")
    df = df.withColumns({"published_at": F.timestamp_seconds("sec"), "deadline": F.lit("d"), "description": F.lit("t")})
    got = rows(merge_sources([df], POLICIES["CL"]), "cluster", "n_records", "status", "amount_local")
    assert [(r[0], r[1], r[2], r[3] and int(r[3])) for r in got] == [("1", 2, "open", 1_000_000), ("3", 1, "news", None)]


def test_secondary_keys_link_within_a_source(spark):
    items = spark.createDataFrame(
        [("1", "Food boxes", "https://a.gov/1"), ("2", "food  Boxes", "https://b.gov/2"), ("3", "Other", "https://c.gov/3")],
        "record_id string, title string, link string",
    ).withColumns({"guid": F.lit(""), "number": F.lit(""), "published_at": F.current_timestamp(), "source": F.lit("fns_rss")})
    fns = with_keys(items, SOURCE_KEYS["fns_rss"])
    rd = with_keys(items.withColumns({"source": F.lit("rd_rss"), "record_id": F.concat(F.lit("r"), "record_id"), "link": F.concat("link", F.lit("0"))}), SOURCE_KEYS["rd_rss"])
    policy = Policy(precedence=("fns_rss", "rd_rss"), fields={"title": "latest_by_precedence"})
    got = rows(merge_sources([fns, rd], policy), "cluster", "n_records")
    # The two boxes of one feed by secondary key; the other feed's by similar title on one host.
    assert got == [("1", 4), ("3", 2)]


def test_audit_history(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 400), (1, "b", 500), (1, "c", 600)], "key int, title string, day int")
    df = df.withColumn("seen_at", F.timestamp_seconds(F.col("day") * 86400))
    got = audit_history(df, "key", "seen_at", POLICIES["NZ"], "1971-09-01")
    assert rows(got, "field", "old_value", "new_value") == [("title", "b", "c")]


def test_declared_records(spark, tmp_path):
    good = {"name": "eID rebate", "jurisdiction": "NSW", "source": "s", "amount": {"min_aud": 0, "max_aud": 11000, "notes": "n"}, "eligible_applicants": ["a"], "citations": ["c"]}
    lines = [json.dumps(good), json.dumps({**good, "amount": "much"}), '{"name": ', json.dumps({"name": "x"})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    df = readers.read_records(spark, str(tmp_path / "r.jsonl"), PROGRAM_WITH_AMOUNT)
    ok, bad = split_valid(df, {**well_formed(), **spec_rules(PROGRAM_WITH_AMOUNT_SPEC)})
    assert rows(ok, "name", "amount.max_aud") == [("eID rebate", 11000.0)]
    assert sorted("malformed record" in r.failed_rules for r in bad.collect()) == [False, True, True]


def test_schemas():
    assert len(PROGRAMS) == 24 and len(PROGRAM_DOCS) == 11 and len(OPPORTUNITY) == 21
    assert len(CANONICAL_PROGRAMS) == 30 and len(CANONICAL_DOCS) == 12


def test_shared_folder(spark):
    folder = shared_dir(spark)
    assert shared_dir(spark) == folder or spark.conf.get("spark.checkpoint.dir", None) is None
    assert new_run_dir(spark, "x") != new_run_dir(spark, "x")
    df = spark.createDataFrame([("abc", 1, ["x"]), (None, 2, None)], "s string, i int, a array<string>")
    assert rows(cut_lineage(df), "*") == rows(df, "*")
    assert measured_bytes(df) > 16 * 6 and measured_bytes(df.limit(0)) == 0


ITEM = "guid string, title string, ts timestamp"


def _land(folder, name, items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("guid", "title", "ts"), i))) for i in items))


def _stream(spark, folder):
    from pyspark.sql.types import _parse_datatype_string

    return jobs.stream_items(spark, str(folder), _parse_datatype_string(ITEM), per_batch=1)


def test_stream_dedupe_across_polls(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    _land(src, "a.json", [("1", "x", "2025-01-01T00:00:00Z"), ("1", "y", "2025-01-01T01:00:00Z")])
    jobs.run_to_files(jobs.stream_dedupe(_stream(spark, src), ["guid"], "ts"), out, cp)
    _land(src, "b.json", [("1", "z", "2025-01-01T02:00:00Z"), ("2", "w", "2025-01-01T02:00:00Z")])
    jobs.run_to_files(jobs.stream_dedupe(_stream(spark, src), ["guid"], "ts"), out, cp)
    assert rows(spark.read.parquet(out), "guid") == [("1",), ("2",)]


@pytest.mark.parametrize("compact", [1, 2, 50])
def test_stream_changes_over_batches_and_replays(spark, tmp_path, compact):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    step = jobs.change_writer(out, "guid", "ts", ["title"], compact)
    polls = [
        [("1", "x", "2025-01-01T00:00:00Z"), ("2", "y", "2025-01-01T00:00:00Z")],
        [("1", "x", "2025-01-01T01:00:00Z"), ("2", "Y", "2025-01-01T01:00:00Z")],
        [("2", "Y", "2025-01-01T02:00:00Z"), ("3", "z", "2025-01-01T02:00:00Z")],
        [("1", "q", "2025-01-01T03:00:00Z"), ("3", "z", "2025-01-01T03:00:00Z")],
    ]
    for i, items in enumerate(polls):
        _land(src, f"{i}.json", items)
        jobs.run_each_batch(_stream(spark, src), step, cp)
    want = [
        (0, "1", "new"), (0, "2", "new"), (1, "1", "unchanged"), (1, "2", "modified"),
        (2, "2", "unchanged"), (2, "3", "new"), (3, "1", "modified"), (3, "3", "unchanged"),
    ]
    assert rows(spark.read.parquet(out + "/changes"), "batch", "guid", "change") == want
    again = spark.createDataFrame([(*p[:2],) for p in polls[2]], "guid string, title string")
    step(again.withColumn("ts", F.lit("2025-01-01 02:00:00").cast("timestamp")), 2)
    assert rows(spark.read.parquet(out + "/changes"), "batch", "guid", "change") == want


def _polls(spark, src, batches):
    """Each batch of (guid, text, seconds) as one landed file."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "guid string, title string, sec long").withColumn(
            "ts", F.timestamp_seconds("sec")
        ).coalesce(1).write.mode("append").parquet(f"{src}/poll={i}")


def _landed(spark, src):
    schema = "guid string, title string, sec long, ts timestamp, poll int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


POLLS = [
    [("a", "x", 10), ("b", "x", 500_000), ("a", "x", 20)],
    [("a", "y", 15), ("c", "q", 7), (None, "n", 3)],
    [("b", "x", 400_000), ("b", "z", 400_001), ("a", "x", 9_000_000), (None, "n", 4)],
    [("c", "q", 8), ("a", "x", 10), ("d", "d", None)],
]


@pytest.mark.parametrize("pack", [2, 50])
def test_first_sight_is_never_forgotten(spark, tmp_path, pack):
    _polls(spark, tmp_path / "in", POLLS)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for bits in (1 << 20, 8):  # with 8 bits every key looks seen
        step = jobs.first_sight_writer(f"{out}{bits}", ["guid"], ["sec"], bits=bits, buckets=4, pack_every=pack)
        jobs.run_each_batch(_landed(spark, tmp_path / "in"), step, f"{cp}{bits}")
        first = spark.read.parquet(f"{out}{bits}/first")
        assert rows(first.na.fill("-", ["guid"]), "guid", "sec") == [("-", 3), ("a", 10), ("b", 500_000), ("c", 7), ("d", None)]
        # a replay of the last batch changes nothing
        last = spark.createDataFrame([("a", "x", 1)], "guid string, title string, sec long").withColumns(
            {"ts": F.timestamp_seconds("sec"), "poll": F.lit(3)}
        )
        step(last, 3)
        assert spark.read.parquet(f"{out}{bits}/first").filter("guid = 'a'").count() == 1


def test_counts_of_all_days_over_batches_and_replays(spark, tmp_path):
    _polls(spark, tmp_path / "in", POLLS)
    step = jobs.count_writer(str(tmp_path / "out"), "ts", "guid")
    jobs.run_each_batch(_landed(spark, tmp_path / "in"), step, str(tmp_path / "cp"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    want = rows(jobs.daily_counts(whole, "ts", "guid").na.fill("-"), "day", "guid", "items")
    got = jobs.read_counts(spark, str(tmp_path / "out"), "guid")
    assert rows(got.na.fill("-"), "day", "guid", "items") == want
    step(whole.filter("poll = 1"), 1)
    assert rows(jobs.read_counts(spark, str(tmp_path / "out"), "guid").filter("guid = 'c'"), "items") == [(2,)]


@pytest.mark.parametrize("with_known", [False, True])
def test_versions_do_not_depend_on_batches(spark, tmp_path, with_known):
    known = None
    if with_known:
        known = spark.createDataFrame([("a", 12, "x"), ("c", 8, "x"), ("z", 1, "x")], "guid string, sec long, title string").select(
            "guid", F.timestamp_seconds("sec").alias("ts"), stable_key("title").alias("content_hash")
        )
        known.write.parquet(str(tmp_path / "known"))
    results = []
    for turn, polls in enumerate((POLLS, POLLS[::-1], [sum(POLLS, [])])):
        src, out = tmp_path / f"in{turn}", str(tmp_path / f"out{turn}")
        _polls(spark, src, polls)
        old = known is not None and spark.readStream.schema(known.schema).parquet(str(tmp_path / "known"))
        found = jobs.stream_versions(_landed(spark, src), "guid", "ts", ["title"], old or None)
        jobs.run_each_batch(found, jobs.version_writer(out), str(tmp_path / f"cp{turn}"), "update")
        last = jobs.read_versions(spark, out, "guid", "ts")
        results.append(rows(last, "guid", "ts", "content_hash", "change"))
    whole = spark.read.parquet(str(tmp_path / "in0")).filter("guid IS NOT NULL AND ts IS NOT NULL")
    batch = jobs.versions(whole, known, "guid", "ts", ["title"])
    assert results[0] == results[1] == results[2] == rows(batch, "guid", "ts", "content_hash", "change")
    marks = {(r["guid"], int(r["ts"].timestamp())): r["change"] for r in batch.collect()}
    if with_known:
        assert [marks["a", s] for s in (10, 15, 20, 9_000_000)] == ["stale", "modified", "modified", "unchanged"]
        assert marks["c", 7] == "stale"
    else:
        assert [marks["a", s] for s in (10, 15, 20, 9_000_000)] == ["new", "modified", "modified", "unchanged"]
        assert [marks["b", s] for s in (400_000, 400_001, 500_000)] == ["new", "modified", "modified"]


def test_every_batch_of_a_stream_has_files_for_all_cores(spark, small, tmp_path):
    from registry.stream_queries import _in_files

    seen = []
    jobs.run_each_batch(
        _in_files(spark, small, 3), lambda batch, _: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())), str(tmp_path / "c")
    )
    total = spark.read.parquet(f"{small}/events.parquet").count()
    assert len(seen) == 3 and sum(n for n, _ in seen) == total
    assert all(files > spark.sparkContext.defaultParallelism / 2 for _, files in seen)


def test_first_sights_of_a_bucket_are_one_file(spark, tmp_path):
    step = jobs.first_sight_writer(str(tmp_path), ["k"], ["id"], bits=1 << 12, buckets=4)
    step(spark.range(0, 400, 1, 8).select("id", (F.col("id") % 100).alias("k")), 0)
    found = spark.read.parquet(f"{tmp_path}/first/batch=0")
    assert found.count() == 100 and len(found.inputFiles()) == 4
