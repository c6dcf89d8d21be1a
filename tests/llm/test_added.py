"""Centroid clusters, the Merkle manifest and packing against plain versions, and on the odd cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import centroids, merkle, packing
from harrow.llm.queries import ORACLES, QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def clash(df):
    # columns that the operators make themselves are there already
    return df.withColumn("node", F.lit(7)).withColumn("tree", F.lit("t")).withColumn("v", F.lit(1)).withColumn("ids", F.lit("x"))


@pytest.mark.parametrize("name", ["op11_centroids", "op12_merkle_manifest"])
def test_queries_equal_their_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


def test_search_equals_all_distances():
    draw = np.random.default_rng(2)
    for spread, offset in ((3, 0), (300, 0), (50, 10**6), (1 << 26, 0)):
        x = draw.integers(-spread, spread + 1, (500, 64)) + offset + draw.integers(-spread, spread + 1, (500, 1))
        c = np.concatenate((x[:30], x[:5], draw.integers(-spread, spread + 1, (5, 64)) + offset))  # with equal centroids
        search = centroids.Search(c)
        number, distance = search(x)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
        assert search.measured < every.size


def test_search_passes_over_most_centroids_of_spread_sums():
    draw = np.random.default_rng(3)
    base = draw.integers(-2000, 2000, (40, 1))
    c = base + draw.integers(-50, 50, (40, 64))
    x = base[draw.integers(0, 40, 1000)] + draw.integers(-50, 50, (1000, 64))
    search = centroids.Search(c)
    search(x)
    assert search.measured < 0.2 * 40 * 1000


def test_centroid_odd_cases(spark):
    plain = [float(i % 7) for i in range(64)]
    rows = [
        (1, plain, 0), (1, plain, 0), (None, plain, 0), (2, None, 0), (3, [], 0), (4, plain[:63], 0), (5, plain + [1.0], 0),
        (6, [None, *plain[1:]], 0), (7, [math.nan, *plain[1:]], 0), (8, [math.inf, *plain[1:]], 0), (9, [-0.001] * 64, 0), (10, [0.0] * 64, 0),
    ]
    frame = clash(spark.createDataFrame(rows, VECTORS))
    got = centroids.centroid_clusters(frame).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([1, 1, None, 9, 10])
    assert {r["distance"] for r in got} == {0}  # fewer vectors than clusters
    assert next(r["centroid"] for r in got if r["vec_id"] == 9) == [-1] * 64  # floor, not truncation
    two = centroids.centroid_clusters(frame, clusters=2, rounds=3).collect()
    assert len({r["cluster"] for r in two}) == 2
    assert all(r["inertia"] == sum(s["distance"] for s in two) for r in two)
    assert centroids.centroid_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.centroid_clusters(spark.createDataFrame([(2, None, 0)], VECTORS)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS)).collect()


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, **changed):
    values = [changed.get(c, row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_manifest(rows, fanout, changed):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for *_, leaf, _ in sorted(by_lang[x], key=lambda m: m[:3])], fanout) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs], fanout)
    out = []
    for x, lang in enumerate(langs):
        for i, (*_, leaf, r) in enumerate(sorted(by_lang[lang], key=lambda m: m[:3])):
            node, proof = plain_leaf(r, n_chars=r["n_chars"] + 1) if changed(r) else leaf, ""
            for at, tree in ((i, trees[lang]), (x, top)):
                for level in tree[:-1]:
                    run = at - at % fanout
                    others = [*level[run:at], node, *level[at + 1 : run + fanout]]
                    proof += "".join(level[run:at] + level[at + 1 : run + fanout])
                    node = digest(others)
                    at //= fanout
            out.append((r["doc_id"], leaf, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (3, 9), (2, 1024)])
def test_manifest_equals_a_plain_one(spark, small, fanout, block):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "x", "en", None, 3), (5001, None, None, "s", None), (5002, "", "", "", 0), (5002, "", "", "", 0), (5002, "é\n" * 9000, "", "s", 7),
         (5003, "lone", "zz", "s", 4)] + [(6000 + i, "same", f"l{i}", "s", 4) for i in range(11)], DOCS,
    )
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)

    def changed(r):
        return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(clash(docs), claimed=claimed, fanout=fanout, block=block)
    want = plain_manifest(docs.collect(), fanout, changed)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len({r[3] for r in want}) == 1 and sum(not r[-1] for r in want) > 5


def test_manifest_of_little(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == ""
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], DOCS), fanout=3, block=1024)


def test_a_level_resumes_from_its_states():
    nodes = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(7)]
    level = merkle.Level(nodes, 3)
    for i in range(7):
        assert level.fold(i, nodes[i]) == level.parents[i // 3]
        left, right = level.siblings(i)
        assert level.fold(i, b"x") == hashlib.sha256(b"".join([*left, b"x", *right])).hexdigest().encode()


def naive_level(level, window, size):
    """The level to place into, from the sums of squares of every choice."""
    best = None
    for h in range(window - size + 1):
        if h and not level[h]:
            continue
        after = list(level)
        after[h] -= h > 0
        after[h + size] += 1
        squares = sum(n * n for n in after[1:window])
        if best is None or squares <= best[0]:
            best = squares, h
    return best[1]


def test_packer_takes_the_least_sum_of_squares():
    draw = np.random.default_rng(4)
    packer = packing.Packer(32)
    for document in range(600):
        size = int(draw.integers(1, 32))
        assert packer.choose(size) == naive_level(packer.level.tolist(), 32, size)
        list(packer.add(document, size))
    assert packer.level[1:32].sum() == packer.n_open == sum(map(len, packer.open))


@pytest.mark.parametrize("limit", [3, 1000])
def test_windows_hold_every_id_once_without_padding(limit):
    draw = np.random.default_rng(5)
    packer, sizes = packing.Packer(64, limit), draw.integers(1, 300, 400).tolist() + [33] * 200
    windows = [w for document, n in enumerate(sizes) for w in packer.add(document, n)] + list(packer.settle())
    assert not packer.n_open and not list(packer.settle())
    held = defaultdict(list)
    for window in windows:
        length = sum(p[2] for p in window)
        assert length == 64 or length & (length - 1) == 0
        for document, at, size in window:
            assert size > 0
            held[document].append((at, size))
    for document, n in enumerate(sizes):
        at = 0
        for start, size in sorted(held[document]):
            assert start == at
            at += size
        assert at == n


def check_pieces(got, docs, library, end_id, window):
    ids_of = [np.array(library.encode(t or "", add_special_tokens=False).ids + ([end_id] if end_id is not None else []), "<u4") for _, t in docs]
    want = Counter((d, ids.tobytes()) for (d, _), ids in zip(docs, ids_of, strict=True) if len(ids))
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        starts[r["doc_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length, whole in sorted(parts):
            assert offset == at
            at += length
        assert at == whole <= window and (at == window or at & (at - 1) == 0)
    return want, starts


def test_packed_documents_equal_the_library(spark, small):
    library = Tokenizer.from_file(WORDS)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, "z" * 3000), (9004, "word " * 30000), (None, "no id"), (9005, "x <|endoftext|> y"), (9006, "a")]
    frame = clash(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS))
    for end_id, window in ((1, 2048), (None, 64)):
        got = packing.packed(frame, WORDS, end_id, window=window, open_windows=20).collect()
        want, by_doc = check_pieces(got, rows, library, end_id, window)
        again = Counter()
        for doc_id, parts in by_doc.items():
            parts.sort(key=lambda r: r["start"])
            assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
            assert {r["doc_tokens"] for r in parts} == {sum(r["length"] for r in parts)}
            again[doc_id, b"".join(r["ids"] for r in parts)] += 1
        assert again == want
    assert packing.packed(spark.createDataFrame([], DOCS), WORDS, 1).collect() == []


def test_repeated_ids_are_packed_apart(spark):
    frame = spark.createDataFrame([(1, "the cat " * 900, "en", "s", 0)] * 3, DOCS)
    got = packing.packed(frame, WORDS, 1).collect()
    assert sum(r["length"] for r in got) == 3 * 1801 and {r["doc_tokens"] for r in got} == {1801}


def test_packing_query_columns(spark, small):
    got = QUERIES["op13_packing"](spark, small)
    assert dict(got.dtypes) == dict.fromkeys(
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint"
    )
    library = Tokenizer.from_file(WORDS)
    text = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    for r in got.limit(50).collect():
        ids = np.array([*library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
