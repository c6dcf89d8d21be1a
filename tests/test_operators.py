"""Operators on hand-made rows, and against slow but plain computations."""

import random

import pytest
from harrow.operators import (
    aggregates,
    clusters,
    columns,
    containment,
    filters,
    fuzzy,
    joins,
    linking,
    quality,
    reshape,
    rules,
    search,
    sorting,
    survivorship,
    windows,
)
from harrow.operators.html import cards_of, extract_cards
from harrow.vocab import FUNDING_TERMS, HELP_TERRITORIES, LOCATION_PROGRAMS, LOCATIONS, MATRIX_KEYWORDS, MATRIX_REGIONS, dimension, dimensions
from pyspark.sql import Window
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pattern_and_literal_search(spark):
    df = spark.createDataFrame([(1, "100% organic"), (2, "100 organic"), (3, r"a\b"), (4, None), (5, "it's")], "id int, s string")
    assert rows(filters.search_literal(df, "0% O", ["s"]), "id") == [(1,)]
    assert rows(filters.search_pattern(df, "100%org", ["s"]), "id") == [(1,), (2,)]
    assert rows(filters.search_pattern(df, "100_org", ["s"]), "id") == [(2,)]
    assert rows(filters.search_pattern(df, "A\\B", ["s"]), "id") == [(3,)]
    assert rows(filters.search_literal(df, "T'S", ["s"]), "id") == [(5,)]
    assert filters.search_literal(df, "", ["s"]).count() == 5
    assert df.filter(~filters.matches_literal("organic", ["s"])).count() == 3


def test_pattern_in_one_of_several_columns(spark):
    df = spark.createDataFrame([(1, None, "Dairy"), (2, "dairy", None), (3, None, None)], "id int, a string, b string")
    assert rows(filters.search_literal(df, "DAIRY", ["a", "b"]), "id") == [(1,), (2,)]


def test_facets_and_ids(spark):
    df = spark.createDataFrame([("1", "CA"), ("2", "US")], "id string, country string")
    assert filters.facet_filter(df, "country", "all").count() == 2
    assert rows(filters.facet_filter(df, "country", "CA"), "id") == [("1",)]
    assert filters.get_by_id(df, "id", "9").count() == 0


def test_headers(spark):
    df = spark.createDataFrame([("", "x", "", "y", "0")], ["Subsidy Program", "Program", "Eligibility Cut-Offs", "Eligibility Cut‑Offs", " Notes/Structure "])
    out = columns.map_headers(df, {"program_name": ["Subsidy Program", "Program"], "eligibility_cutoffs": ["Eligibility Cut-Offs"], "notes_structure": ["Notes/Structure"], "focus": ["Focus"]}, default="")
    assert rows(out, "*") == [("x", "y", "0", "")]
    assert columns.normalize_header(" A –  B") == "a - b"
    assert columns.unify_headers(df).columns == ["subsidy program", "program", "eligibility cut-offs", "notes/structure"]


def test_doc_targets(spark):
    df = spark.createDataFrame([(1, "canada/a.pdf", "https://x"), (2, "", "https://x"), (3, None, "")], "id int, file_slug string, source_url string")
    got = rows(df.select("id", columns.resolve_doc_target()["href"].alias("h")), "id", "h")
    assert got == [(1, "/pdfs/canada/a.pdf"), (2, "https://x"), (3, None)]


def test_locale_order(spark):
    df = spark.createDataFrame([(i, "CA", n) for i, n in enumerate(["b", "A", "é", "a", "B", "f"])], "id int, country string, program_name string")
    ordered = [r.program_name for r in sorting.sort_catalog(df, "name", locale=True).collect()]
    assert ordered == ["a", "A", "b", "B", "é", "f"]


def test_full_locale_order_query(spark, tmp_path):
    from registry import QUERIES

    names = ["b", "A", "é", "a", "B", "f"]
    pages = [(i, "", f'<html lang="en"><title>{names[i % 6]}</title></html>') for i in range(120)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.program_name, r.id) for r in QUERIES["sorted_locale_aware"](spark, str(tmp_path)).collect()]
    assert got == [(n, i) for n in ["a", "A", "b", "B", "é", "f"] for i in range(120) if names[i % 6] == n]


def test_deadline_order(spark):
    data = [(1, "", "2 March 2025"), (2, "10/02/2025", ""), (3, None, None), (4, "Rolling", None)]
    df = spark.createDataFrame(data, "id int, closing_date string, application_deadline string")
    assert [r.id for r in sorting.sort_catalog(df, "deadline").collect()] == [2, 1, 4, 3]
    assert [r.id for r in sorting.sort_catalog(df, "deadline", mode="text").collect()] == [2, 1, 4, 3]


def test_dimensions(spark):
    counts = {r[0]: r[1] for r in dimensions(spark).groupBy("dimension").count().collect()}
    assert counts == {"operation": 6, "scale": 4, "practice": 14, "location": 48, "doc_type": 8}
    assert dimension(spark, "scale").count() == 4 and len(LOCATIONS) == 48


def test_prefix_rules_agree(spark):
    df = spark.createDataFrame([("canada-bc",), ("chile-x",), ("us-iowa",), ("newzealand",), (None,), ("",)], "location string")
    table = spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(LOCATION_PROGRAMS)], "prefix string, priority int, program string, rule_type string, next_date string")
    from harrow.vocab import DEFAULT_PROGRAM

    default = dict(zip(("program", "rule_type", "next_date"), DEFAULT_PROGRAM))
    shown = ["location", "program", "rule_type", "next_date", "matched"]
    a = joins.rule_by_prefix(df, "location").select(*shown)
    b = joins.prefix_join(df, "location", table, default).select(*shown)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_counts_keep_every_territory(spark):
    dim = spark.createDataFrame([(t,) for t in HELP_TERRITORIES], "country string")
    stats = aggregates.stats_by(spark.createDataFrame([("CA",), ("CA",), ("LATAM",)], "country string"), "country")
    got = dict(rows(joins.counts_for(dim, stats, "country"), "*"))
    assert got == {"CA": 2, "US": 0, "AU": 0, "NZ": 0, "BR": 0, "CL": 0}


def test_request_matrix(spark):
    words = spark.createDataFrame([(k,) for k in MATRIX_KEYWORDS], "keyword string")
    out = joins.request_matrix(words, "keyword", MATRIX_REGIONS, "https://x/?k={keyword}&r={region}")
    assert out.count() == 14 * 13
    url = out.filter("keyword = 'Honey Bee Compensation' AND region = 'Nova%20Scotia'").first()["url"]
    assert url == "https://x/?k=Honey%20Bee%20Compensation&r=Nova%20Scotia"


def test_answers(spark):
    df = spark.createDataFrame([("When are the next deadlines?",), ("other",), ("  ",)], "text string")
    got = joins.answer_lookup(df, "text")
    assert got.count() == 2
    assert got.filter("intent = 'submission'").count() == 1


def test_linking_goldens(spark):
    programs = spark.createDataFrame(
        [("p2", "Agri Program"), ("p1", "agri program"), ("p3", ""), ("p4", "Clean Technology"), ("p5", "Tech"), ("p6", "b")],
        "id string, program_name string",
    )
    docs = spark.createDataFrame(
        [(1, "AGRI PROGRAM"), (2, "Agricultural Clean Technology Program"), (3, "none here"), (4, ""), (5, None), (6, "Tech"), (7, "b"), (8, "xbx")],
        "doc int, program_title string",
    )
    got = rows(linking.link_documents(docs, programs), "doc", "program_id", "match_kind")
    assert got == [
        (1, "p1", "exact"), (2, "p4", "partial"), (3, None, "none"), (4, None, "none"),
        (5, None, "none"), (6, "p5", "exact"), (7, "p6", "exact"), (8, "p6", "partial"),
    ]


def _words(rng, n):
    return " ".join(rng.choice(["agri", "fund", "été", "a", "of", "the", "program", "soil", "x-y"]) for _ in range(n))


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_containment_equals_all_pairs(spark, limit):
    rng = random.Random(3)
    texts = {i: _words(rng, rng.randint(0, 30)) for i in range(120)}
    texts.update({200 + i: "the common passage repeated in a third of all texts " + str(i % 3) for i in range(60)})
    needles = {t[s : s + n] for t in list(texts.values()) for s, n in [(rng.randint(0, 9), rng.randint(0, 40))]}
    needles |= {"é", "ab", "passage repeated", "nowhere in there at all", ""}
    want = sorted((i, n) for i, t in texts.items() for n in needles if n and n in t)
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert rows(containment.contained_pairs(left, "needle", right, "id", "text", limit), "id", "needle") == want


def test_containment_with_few_texts_and_many_needles(spark):
    rng = random.Random(8)
    texts = {1: _words(rng, 20), 2: "soil of the program"}
    needles = {_words(rng, rng.randint(1, 6)) for _ in range(900)} | {t[3:14] for t in texts.values()}
    want = sorted((i, n) for i, t in texts.items() for n in needles if n and n in t)
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = containment.contained_pairs(left, "needle", right, "id", "text", 12_000)
    assert rows(got, "id", "needle") == want and len(want) > 5


def _distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("threshold, hot", [(0.67, 3), (0.75, 2000), (0.86, 3), (0.88, 2000), (1.0, 3)])
def test_fuzzy_equals_all_pairs(spark, threshold, hot, monkeypatch):
    monkeypatch.setattr(fuzzy, "HOT_KEY", hot)
    rng = random.Random(int(threshold * 100))
    data, alphabet = [], "abcé "
    for i in range(160):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        if i % 3 == 0:
            base = "media release of the minister " + base
        data.append((i, base, "h" + str(i % 2)))
        edited = list(base)
        for _ in range(rng.randint(0, 2)):
            edited[rng.randrange(len(edited))] = rng.choice(alphabet)
        data.append((1000 + i, "".join(edited), "h" + str(i % 2)))
    data += [(5000, None, "h0"), (5001, "abc", None), (5002, "  ", "h0")]
    reps: dict = {}
    for i, t, h in data:
        if t and t.split() and h:
            reps.setdefault((h, " ".join(t.split())), []).append(i)
    groups = [(min(ids), h, t) for (h, t), ids in reps.items()]
    slack = round((1 - threshold) * 1000)
    want = sorted(
        (min(a, b), max(a, b))
        for n, (a, h, s) in enumerate(groups)
        for b, g, t in groups[:n]
        if h == g and _distance(s, t) * 1000 <= slack * max(len(s), len(t))
    )
    df = spark.createDataFrame(data, "id int, title string, host string")
    assert rows(fuzzy.fuzzy_match(df, "id", "title", ["host"], threshold), "a", "b") == want


def test_fuzzy_rejects_thresholds_that_mean_nothing(spark):
    df = spark.createDataFrame([(1, "a", "h")], "id int, title string, host string")
    for threshold in (0, 1.5):
        with pytest.raises(ValueError):
            fuzzy.fuzzy_match(df, "id", "title", ["host"], threshold)


def _components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return sorted((i, find(i)) for i in ids)


@pytest.mark.parametrize("threshold, few, hubs, rounds", [(0.3, 4, 2, 3), (0.86, 2, 1, 2), (0.9, 1, 4, 12)])
def test_similar_clusters_equal_all_pairs(spark, threshold, few, hubs, rounds, monkeypatch):
    monkeypatch.setattr(fuzzy, "ALL_PAIRS", few)
    monkeypatch.setattr(fuzzy, "HUBS", hubs)
    monkeypatch.setattr(fuzzy, "ROUNDS", rounds)
    rng = random.Random(int(threshold * 100) + few)
    data = []
    for i in range(150):
        kind = i % 4
        if kind == 0:  # one family, numbered
            title = f"round {rng.randrange(10**4):05d} of the water fund"
        elif kind == 1:  # boilerplate around words that differ
            title = "media release of the minister " + "".join(rng.choice("abcdefgh") for _ in range(14))
        else:
            title = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 12)))
        data.append((i, title, "h" + str(i % 3 // 2)))
    data += [(500, None, "h0"), (501, "  ", "h0"), (502, "abc", None)]
    titled = {i: (h, " ".join(t.split())) for i, t, h in data if t and t.split() and h}
    slack = round((1 - threshold) * 1000)
    pairs = [
        (a, b)
        for a, (h, s) in titled.items()
        for b, (g, t) in titled.items()
        if a < b and h == g and _distance(s, t) * 1000 <= slack * max(len(s), len(t))
    ]
    df = spark.createDataFrame(data, "id int, title string, host string")
    got = fuzzy.similar_clusters(df, "id", "title", ["host"], threshold)
    assert rows(got, "id", "cluster") == _components([i for i, *_ in data], pairs)


def test_similar_titles_make_links_in_proportion(spark):
    title = F.concat(F.lit("Round "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" of the rural water fund"))
    made = []
    for n in (700, 2_800):
        df = spark.range(n).select("id", title.alias("title"), F.lit("h").alias("host"))
        links = fuzzy.match_edges(df, "id", "title", ["host"], 0.86).cache()
        made.append(links.count())
        assert clusters.with_clusters(df, "id", links).filter("cluster <> 0").count() == 0
    assert made[1] < 5 * made[0]


def test_similar_titles_compare_few_pairs(spark):
    title = F.concat(F.md5(F.col("id").cast("string")), F.element_at(F.array(F.lit(" Program"), F.lit("s")), (F.col("id") % 2 + 1).cast("int")))
    df = spark.range(4_000).select("id", title.alias("title"), F.when(F.col("id") < 3_000, "h").otherwise(F.col("id").cast("string")).alias("host"))
    few, many = fuzzy._blocked(fuzzy.title_groups(df, "id", "title", ["host"]), ["host"])
    assert (few.count(), many.count()) == (0, 3_000)  # a title alone in its block is compared with none
    counts = fuzzy._Counts(many, fuzzy._run_length(0.86))
    chunks, grams = fuzzy._chunks(many, counts, 0.86), fuzzy._grams(many, 0.86)
    assert chunks.count() <= 6 * 3_000
    met = chunks.join(grams.withColumnRenamed("rep", "other"), ["block", "gram"]).filter("rep <> other").count()
    assert met < 3_000 * 3_000 / 100


@pytest.mark.parametrize("threshold, few, hubs", [(0.67, 2, 2), (0.86, 2, 1), (0.9, 32, 8)])
def test_titles_in_passes_equal_all_pairs(spark, threshold, few, hubs, monkeypatch):
    for name, value in (("FILTERED_RUNS", 0), ("PASS_RUNS", 1500), ("ALL_PAIRS", few), ("HUBS", hubs), ("HOT_KEY", 3)):
        monkeypatch.setattr(fuzzy, name, value)
    rng = random.Random(few)
    data = []
    for i in range(90):
        base = "".join(rng.choice("abcdé🌾 ") for _ in range(rng.randint(4, 20)))
        base = "media release of the minister " + base if i % 3 == 0 else base
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "x", "éa"])
        data += [(i, base, "h"), (1000 + i, "".join(edited), "h")]
    titled: dict = {}
    for i, t, _ in data:
        if t.split():
            titled.setdefault(" ".join(t.split()), i)
    slack = round((1 - threshold) * 1000)
    pairs = sorted(
        (min(a, b), max(a, b))
        for s, a in titled.items()
        for t, b in titled.items()
        if a < b and _distance(s, t) * 1000 <= slack * max(len(s), len(t))
    )
    df = spark.createDataFrame(data, "id int, title string, host string")
    assert rows(fuzzy.fuzzy_match(df, "id", "title", ["host"], threshold), "a", "b") == pairs
    equal = [(titled[" ".join(t.split())], i) for i, t, _ in data if t.split()]
    got = fuzzy.similar_clusters(df, "id", "title", ["host"], threshold)
    assert rows(got, "id", "cluster") == _components([i for i, *_ in data], pairs + equal)


def test_runs_that_are_no_chunk_are_dropped_before_the_join(spark):
    titles = spark.range(3_000).select(F.col("id").alias("rep"), F.md5(F.col("id").cast("string")).alias("title_norm"), F.lit("h").alias("host"))
    _, many = fuzzy._blocked(titles, ["host"])
    counts = fuzzy._Counts(many, fuzzy._run_length(0.86))
    chunks, grams = fuzzy._chunks(many, counts, 0.86), fuzzy._grams(many, 0.86)
    on = ["rep", "block", "gram"]
    held = fuzzy._held(grams, chunks)
    assert held.columns == grams.columns and held.count() < grams.count() / 4
    need = grams.join(chunks.select("block", "gram").distinct(), ["block", "gram"]).select(*on)
    assert need.subtract(held.select(*on)).count() == 0
    parts = [fuzzy._of_pass(grams, n, 3) for n in range(3)]
    assert sum(p.count() for p in parts) == grams.count() and min(p.count() for p in parts) > grams.count() / 4


def test_equal_titles_link_as_a_star(spark):
    df = spark.createDataFrame([(i, "same title", "h") for i in range(50)], "id int, title string, host string")
    links = fuzzy.match_edges(df, "id", "title", ["host"], 0.86)
    assert links.count() == 49
    got = clusters.with_clusters(df, "id", links)
    assert got.select("cluster").distinct().collect()[0][0] == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(400 + i, 401 + i) for i in range(60)]  # a long chain
    pairs += [(600, 601 + i) for i in range(100)] + [(5, 5)]  # a hub and a loop
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in parent)
    links = spark.createDataFrame(pairs, "u int, v int")
    assert rows(clusters.connected_components(links), "id", "cluster") == want
    assert clusters.connected_components(links.filter("u < 0")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1 << 12).selectExpr("id as u", "id + 1 as v")
    assert clusters.connected_components(links).where("cluster <> 0").count() == 0


def _log(spark):
    rng = random.Random(9)
    data = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(0, 400_000), rng.random() < 0.4, rng.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(data, "id int, k string, sec long, failed boolean, v string")
    return df.withColumn("ts", F.timestamp_seconds("sec")).withColumn("ts", F.when(F.col("id") % 50 != 0, F.col("ts")))


@pytest.mark.parametrize("slices", [None, 3, 40])
def test_sliced_windows_equal_plain_ones(spark, slices):
    log = _log(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = log.withColumns({"p": F.lag("v").over(w), "n": F.row_number().over(w)}).filter("n > 1 AND NOT (p <=> v)")
    got = windows.diff_history(log, "k", ["ts", "id"], ["v"], slices)
    assert rows(got.select("id", "old_value", "new_value").fillna("-"), "*") == rows(plain.select("id", "p", "v").fillna("-"), "*")
    rate = F.round(F.avg(F.col("failed").cast("int")).over(w.rowsBetween(-19, 0)), 6)
    assert rows(windows.rolling_failure_rate(log, "k", ["ts", "id"], "failed", 20, slices), "id", "failure_rate") == rows(log.withColumn("r", rate), "id", "r")


def test_a_key_of_one_day_and_one_without_times_lie_in_many_slices(spark):
    day = F.timestamp_seconds(F.lit(86_400) + F.col("id") % 60)
    hot = spark.range(4000).select("id", F.lit("day").alias("k"), day.alias("ts"), (F.col("id") % 7 == 0).alias("failed"))
    late = spark.range(4000, 8000).select("id", F.lit(None).cast("string").alias("k"), F.lit(None).cast("timestamp").alias("ts"), (F.col("id") % 5 == 0).alias("failed"))
    log = hot.unionByName(late)
    cut = windows.sliced(log, "k", ["ts", "id"], 16).groupBy("k", "_s").count().collect()
    assert max(r["count"] for r in cut) < 1500
    assert min(sum(r["k"] == k for r in cut) for k in ("day", None)) >= 6
    w = Window.partitionBy("k").orderBy("ts", "id")
    prev = windows.with_previous(log, "k", ["ts", "id"], ["id"], 16).select("id", F.col("prev.id").alias("p"))
    assert rows(prev.fillna(-1), "id", "p") == rows(log.select("id", F.coalesce(F.lag("id").over(w), F.lit(-1)).alias("p")), "id", "p")
    rate = F.round(F.avg(F.col("failed").cast("int")).over(w.rowsBetween(-19, 0)), 6)
    got = windows.rolling_failure_rate(log, "k", ["ts", "id"], "failed", 20, 16)
    assert rows(got, "id", "failure_rate") == rows(log.withColumn("r", rate), "id", "r")


def test_deep_pages_equal_the_whole_order(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 9 != 0, F.col("id") % 50).alias("n"))
    whole = [tuple(r) for r in df.orderBy("n", "id").collect()]
    for start, n in ((0, 10), (1234, 100), (4990, 50), (6000, 5)):
        for front in (0, 10_000):
            got = [tuple(r) for r in sorting.page(df, ["n", "id"], start, n, slices=12, front=front).collect()]
            assert got == whole[start : start + n]


def test_changed_snapshots_threshold(spark):
    texts = ["", "x" * 199, "x" * 399, "x" * 398 + "y", "z" * 399, None, "a" * 250]
    data = [(i, "p", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id int, page string, text string").withColumn("ts", F.timestamp_seconds("id"))
    # 199 added: no; 200 added: yes; one changed: no; all changed: yes; emptied: yes; refilled: yes
    assert rows(windows.changed_snapshots(df, "page", ["ts", "id"], "text"), "id") == [(2,), (4,), (5,), (6,)]


def test_keep_latest_is_idempotent_and_keeps_null_ids(spark):
    df = spark.createDataFrame(
        [("1", "k", None, None), ("2", "k", 5, None), ("3", "k", 5, None), ("4", "m", 1, "r"), ("5", "n", 2, "r"), ("6", "o", 2, "")],
        "id string, key string, sec long, rfx string",
    ).withColumn("ts", F.timestamp_seconds("sec"))
    once = windows.keep_latest(df, "key", ["ts"], "id")
    assert rows(once, "id") == [("2",), ("4",), ("5",), ("6",)]
    assert rows(windows.keep_latest(once, "key", ["ts"], "id"), "id") == rows(once, "id")
    assert rows(windows.collapse_by(once, "rfx", ["ts"], "id"), "id") == [("2",), ("5",), ("6",)]
    marked = windows.mark_superseded(df, "key", ["ts"], "id")
    assert rows(marked.filter("superseded_by IS NOT NULL"), "id", "superseded_by") == [("1", "2"), ("3", "2")]


def test_survivorship_does_not_depend_on_order(spark):
    rng = random.Random(1)
    data = [
        (i, i % 3, rng.choice(["a", "b", "c", "zz"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "", "t1", "t22", "<b>t</b>"]), rng.choice([None, 1.5, 2.5]))
        for i in range(90)
    ]
    schema = "record_id int, cluster int, source string, sec long, title string, amount double"
    names = ["latest_by_precedence", "longest_by_precedence", "richest_html_by_precedence", "first_non_null_by_precedence", "latest_by_date", "richest_html_by_date"]

    def run(order):
        df = spark.createDataFrame(order, schema).withColumns(
            {"published_at": F.timestamp_seconds("sec"), "rank": survivorship.source_rank("source", ["a", "b", "c"])}
        ).repartition(5)
        df = df.withColumns({n: F.col("title") for n in names} | {n: F.col("amount") for n in ("max_by_precedence", "earliest_by_precedence", "max_by_date", "earliest_non_null", "latest_crawl")})
        rules_ = {n: n for n in df.columns if n in survivorship.RULES}
        return [tuple(r) for r in survivorship.survive(df, "cluster", rules_).orderBy("cluster").collect()]

    first = run(data)
    for seed in range(2):
        mixed = data[:]
        random.Random(seed).shuffle(mixed)
        assert run(mixed) == first


def test_survivorship_all_null_and_lists(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", None, ["x", "y"], 0), (2, 1, "b", "", ["y", None], 1), (3, 2, "b", "t", None, 1)],
        "record_id int, cluster int, source string, title string, tags array<string>, rank int",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    out = survivorship.survive(df, "cluster", {"title": "latest_by_precedence", "tags": "union_unique"})
    assert rows(out, "*") == [(1, 2, None, ["x", "y"]), (2, 1, "t", [])]


def test_reshape(spark):
    df = spark.createDataFrame([("1", "a", "", 5), ("2", None, "x", None)], "id string, `Col A` string, b string, c int")
    long = reshape.sweep_attributes(df, "id", [])
    assert rows(long, "*") == [("1", "Col A", "a"), ("1", "c", "5"), ("2", "b", "x")]
    wide = reshape.pivot_attributes(long, ["Col A", "b"])
    assert rows(wide, "*") == [("1", "a", None), ("2", None, "x")]
    a = spark.createDataFrame([("u1",), ("u2",)], "url string")
    b = spark.createDataFrame([("u2",), ("u3",)], "url string")
    assert rows(reshape.reconcile(a, b, ["url"]), "*") == [("u1", "active_only"), ("u2", "both"), ("u3", "allowed_only")]


def test_validation_splits_completely(spark):
    df = spark.createDataFrame([(1, "t", "rss", 1.0), (2, " ", "rss", 1.0), (3, None, "tv", -1.0), (4, "t", None, None)], "id int, title string, source string, amount double")
    spec = {"required": ["title"], "properties": {"source": {"enum": ["rss", "page"]}, "amount": {"minimum": 0}}}
    good, bad = quality.split_valid(df, quality.spec_rules(spec))
    assert rows(good, "id") == [(1,), (4,)]
    assert rows(bad, "id", "failed_rules") == [(2, ["missing title"]), (3, ["missing title", "source not in vocabulary", "amount below 0"])]


def test_paths(spark):
    given = ["canada/a.PDF", "../x.pdf", "%2e%2e/x.pdf", "canada/../a.pdf", "x.txt", "%zz.pdf", "a%20b.pdf", "a+b.pdf", "../pdfs-old/x.pdf", None]
    docs = spark.createDataFrame(list(enumerate(given)), "id int, file_slug string")
    files = spark.createDataFrame([("canada/a.PDF",), ("a.pdf",), ("a b.pdf",)], "path string")
    got = [r[1] for r in rows(quality.audit_doc_paths(docs, files), "id", "path_status")]
    assert got == ["ok", "outside_root", "outside_root", "ok", "not_pdf", "bad_encoding", "ok", "missing", "outside_root", "bad_encoding"]


def test_funding_terms(spark):
    df = spark.createDataFrame([(1, "A Cost-Share plan", None), (2, None, "INSURANCE"), (3, "none", "")], "id int, title string, summary string")
    assert rows(filters.include_any(df, ["title", "summary"], FUNDING_TERMS), "id") == [(1,), (2,)]


def test_rules(spark):
    df = spark.createDataFrame([("Open, later closed", 1), ("now closed", 2), ("", 3), (None, 4)], "text string, id int")
    assert [r[1] for r in rows(df.select("id", rules.infer_status("text").alias("s")), "id", "s")] == ["open", "closed", None, None]
    text = spark.createDataFrame([("farmers with ABN keep sheep",), ("sheep only",), ("university topic",)], "t string")
    assert rows(rules.classify(text, "t"), "t", "applicant_types") == [("farmers with ABN keep sheep", ["primary_producer"]), ("university topic", ["research_org"])]
    sent = spark.createDataFrame([("USDA-AMS", "modified"), ("NSF", "posted"), (None, None)], "agencyCode string, oppStatus string")
    assert rows(rules.route(sent), "destination") == [("alerts_updates",), ("index_grants",), ("queue_ams",)]


def _rows_made(df):
    """The row counts of every operator of a plan that has run."""
    made = []

    def visit(node):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            made.append(metrics.apply("numOutputRows").value())
        name = node.getClass().getSimpleName()
        children = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else []
        if name.endswith("QueryStageExec"):
            children.append(node.plan())
        kids = node.children()
        for child in children + [kids.apply(i) for i in range(kids.size())]:
            visit(child)

    df.count()
    plan = df._jdf.queryExecution()
    df.collect()
    visit(plan.executedPlan())
    return made


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_search_index_equals_single_queries(spark, limit):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, _words(rng, 12), _words(rng, 3)) for i in range(80)], "id int, title string, tags string")
    asked = {1: "the soil", 2: "Été of x", 3: "nothing", 4: "agri"}
    index = search.token_index(docs, "id", {"title": 3, "tags": 1})
    asked |= {5: "soil THE", 6: "", 7: "zz the soil", 8: "soil", 9: "soil soil"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got = rows(search.search_index(index, queries, "id", limit), "query_id", "id", "score")
    want = sorted(
        (q, r["id"], r["score"])
        for q, text in asked.items()
        for r in search.search_tokens(docs, text, {"title": 3, "tags": 1}).collect()
    )
    assert got == want and len(got) > 5
    assert {r["matched_terms"] for r in search.search_index(index, queries, "id", limit).filter("query_id = 5").collect()} <= {2}


def test_a_word_of_every_text_and_query_makes_no_product(spark):
    docs = spark.range(3000).select("id", F.concat(F.lit("the w"), F.col("id").cast("string")).alias("t"))
    queries = spark.range(3000).select(F.col("id").alias("query_id"), F.concat(F.lit("the w"), F.col("id").cast("string")).alias("query"))
    found = search.search_index(search.token_index(docs, "id", {"t": 1}), queries, "id")
    assert found.count() == 3000 and found.filter("query_id <> id OR score <> 2").count() == 0
    made = _rows_made(found)
    assert max(made) < 20_000  # far from 3000 * 3000


def test_as_map_of_any_size(spark):
    df = spark.range(10_001).select(F.col("id").cast("string").alias("k"), "id")
    assert len(aggregates.as_map(df, "k", "id").first()[0]) == 10_001
    dealt = aggregates.as_map(df, "k", "id", parts=7).collect()
    assert len(dealt) == 7 and len({k for r in dealt for k in r[0]}) == 10_001


CARDS = """<ul><li class="program-card big"><div class="program-card__title"><a href="/p?a=1&amp;b=2">Honey &amp; Bee</a></div>
<p class="program-card__summary">One<br>two <i>three</p></li>
<li class="program-card"><h2 class="program-card__title">No link</h2><img class="program-card__summary" src="x"></li></ul><p class="program-card__summary">out</p>"""
FIELDS = {"title": ".program-card__title", "href": ".program-card__title a[href]", "summary": ".program-card__summary"}


def test_cards(spark):
    got = cards_of(CARDS, ".program-card", FIELDS)
    assert got[0] == {"title": "Honey & Bee", "href": "/p?a=1&b=2", "summary": "Onetwo three"}
    assert got[1] == {"title": "No link", "summary": ""}
    table = """<body id=main class="x y"><table><tr><td>Close Date</td><td>1 May</td></tr><tr><td>Organisation
    </td><td><b>MPI</b></td></tr></table><time datetime="2025-01-01">x</time><a href="/g.pdf">Applications open</a><a href="/h">h</a></body>"""
    spec = {
        "close": "td:contains('Close Date') + td::text",
        "org": "h9::text, td:contains(\"Organisation\") + td",
        "when": "time[datetime]::attr(datetime)",
        "pdf": "a[href*='.pdf']::attr(href)",
        "status": "*:contains('closed'), *:contains('open')::text",
        "none": "tr + td",
        "exact": "a[href='/h']",
    }
    assert cards_of(table, "#main.x.y, nothing", spec) == [
        {"close": "1 May", "org": "MPI", "when": "2025-01-01", "pdf": "/g.pdf", "status": "Applications open", "exact": "h"}
    ]
    assert cards_of(None, ".x", FIELDS) == [] and cards_of("<li>", "li", {}) == [{}]
    pages = spark.createDataFrame([(1, CARDS), (2, None), (3, "<p>")], "page_id int, html string")
    out = extract_cards(pages, ".program-card", FIELDS, keep=["page_id"])
    assert rows(out, "page_id", "card_no", "title") == [(1, 1, "Honey & Bee"), (1, 2, "No link")]
