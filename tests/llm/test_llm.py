"""Every operator against a plain version of it, on small inputs and on the odd cases."""

import hashlib
import itertools
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import decontaminate, jaccard, language, lines, nbest, neighbours, ngramjoin, quality, suffixes, textblocks, tokenfile, transducer
from harrow.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "It's ''s 'll we'rex !'s 12½"), (6, "İ̧ Σσς Å 漢字 \U0001f642"),
    (7, "x <|endoftext|> y<|startoftext|>"), (8, "z" * 3000), (9, "the cat " * 40), (9, "the cat " * 40), (None, "no id"),
]


def frame(spark, rows):
    # columns that an operator makes itself are there already, and clash
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).withColumn("id", F.lit(7)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_packing_holds_every_width():
    draw = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 15, 16, 17, 20, 31, 32):
        ids = draw.integers(0, 1 << bits, 1001, dtype=np.uint64)
        raw = tokenfile.pack(ids, bits)
        assert len(raw) == -(-1001 * bits // 8)
        assert (tokenfile.unpack(raw, bits, 1001) == ids).all()
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([8]), 3)


def test_token_files_equal_the_library(spark, rows, library):
    some = [r for r in ODD if r[0] is not None] + rows
    got = tokenfile.token_files(frame(spark, some), WORDS, 2).collect()
    want, start = [], 0
    for doc_id, text in sorted(some, key=lambda r: (r[0], r[1] or "")):
        ids = [*ids_of(library, text), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(ValueError):
        tokenfile.token_files(frame(spark, ODD), WORDS, 2)
    assert tokenfile.token_files(frame(spark, []), WORDS, 2).count() == 0


def test_token_file_random_access(spark, rows, library, tmp_path):
    writer = tokenfile.Writer(str(tmp_path / "a.tok"), 49408, block=100)
    texts = [t for _, t in rows[:50]]
    ids = [np.array(ids_of(library, t), np.uint32) for t in texts]
    writer.add(np.arange(50), np.array([len(i) for i in ids]), np.concatenate(ids))
    assert writer.close() == (50, sum(map(len, ids)))
    reader = tokenfile.Reader(str(tmp_path / "a.tok"))
    assert all((reader.document(i) == ids[i]).all() for i in (49, 0, 17))


def test_token_counts_equal_the_library(spark, rows, library, monkeypatch):
    got = Counter(map(tuple, transducer.token_counts(frame(spark, ODD + rows), WORDS).collect()))
    want = Counter()
    for d, t in ODD + rows:
        n = len(ids_of(library, t))
        want[d, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    counter = transducer.Counter(WORDS)
    monkeypatch.setattr(transducer, "CHUNK_CHARS", 5)  # state maps of many stretches
    counter.machine.kept_states = 50
    texts = [t for _, t in ODD] + [t[:400] for _, t in rows[:40]]
    assert counter.counts(texts).tolist() == [len(ids_of(library, t)) for t in texts]


def test_composing_state_maps_is_associative():
    def count(text):
        return sum(map(len, text.split()))

    parts = [("ab", None, ""), ("c", 4, "d"), ("", 0, "ef"), ("g", None, "")]
    for a, b, c in itertools.product(parts, repeat=3):
        assert transducer.then(transducer.then(a, b, count), c, count) == transducer.then(a, transducer.then(b, c, count), count)


def test_languages(spark, docs):
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language.languages(frame(spark, ODD)).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert language.languages(frame(spark, [])).count() == 0
    unlabelled = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(unlabelled).collect()} == {"und"}


def test_trigram_vectors_are_made_some_at_a_time(monkeypatch):
    class Taken:  # stands for a frame and keeps what it is to run
        select = where = lambda self, *_: self
        schema = type("S", (), {"fields": []})

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

        groupBy = agg = lambda self, *_: self  # noqa: N815
        collect = lambda self: []

    draw = np.random.default_rng(31)
    texts = ["".join(chr(c) for c in draw.integers(97, 123, 9000)) for _ in range(5)]
    grams, sizes = language.gram_vectors, []
    monkeypatch.setattr(language, "gram_vectors", lambda numbers: sizes.append(len(numbers)) or grams(numbers))
    frame_ = Taken()
    monkeypatch.setattr(language.F, "col", lambda _: Taken())
    monkeypatch.setattr(language.F, "sum", lambda _: None)
    monkeypatch.setattr(language.F, "array", lambda *_: Taken())
    monkeypatch.setattr(Taken, "__getitem__", lambda self, _: None, raising=False)
    monkeypatch.setattr(Taken, "alias", lambda self, _: self, raising=False)
    language.learn(frame_)
    made = [r for b in frame_.run([pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 5})]) for r in b.to_pylist()]
    numbers, _, _ = language.grams(texts)
    found, counts = np.unique(numbers, return_counts=True)
    assert np.concatenate([r["part"] for r in made]).tolist() == (counts @ grams(found).astype(float)).tolist()
    assert len(found) > 4 * max(sizes)
    sizes.clear()
    language.predict(frame_, {"en": np.ones(language.DIMENSIONS) / 32})
    assert sum(b.num_rows for b in frame_.run([pa.RecordBatch.from_pydict({"_text": texts})])) == 5
    assert len(found) > 4 * max(sizes)


def test_trigram_vectors_are_products_of_rotated_letters():
    numbers, text, _ = language.grams(["ab"])
    plain = language._letter_vectors()[0]
    want = plain[0] * np.roll(plain[1], 1) * np.roll(plain[2], 2)
    assert (language.gram_vectors(numbers[:1])[0] == want).all()


def test_every_labelled_row_is_used_alike():
    class Seen(quality.Network):
        def _forward(self, x):
            if len(x) <= 256:
                used.update(x[:, 0].tolist())
            return super()._forward(x)

    used = Counter()
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 3))
    Seen(3).fit(x, (x[:, 1] > 0).astype(float))
    assert len(used) == 1600 and len(set(used.values())) == 1


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert right >= 0.9 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    odd = quality.quality_scores(frame(spark, ODD), none).collect()
    assert len(odd) == len(ODD) and {round(r["score"], 6) for r in odd} == {0.5}
    assert quality.quality_scores(frame(spark, []), labels).count() == 0


def brute_components(sets, num, den):
    """Component by links of Jaccard similarity; ids in order."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def word_sets(rows, width):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def family(n, length, seed):
    """One base text and edited copies of it, some too far from the base to be linked with it."""
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in draw.integers(0, 10**6, length)]
    out = [" ".join(base)]
    for k in range(n):
        words = list(base)
        for at in draw.integers(0, length, k % 7):
            words[at] = f"x{draw.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_ngram_components_equal_all_pairs(spark, rows, width, num):
    texts = [t for _, t in ODD[:8]] + family(60, 90, 1) + family(40, 30, 2) + ["A b C d e", "a B c D e", "a b", "a b"]
    some = [(1000 + i, t) for i, t in enumerate(texts)] + rows
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_components(frame(spark, some), width, num, 100).collect()}
    sets = word_sets(some, width)
    found = brute_components({i: s for i, s in sets.items() if s}, num, 100)
    assert got == {i: (len(s), found.get(i, i)) for i, s in sets.items()}


def test_ngram_components_odd(spark):
    got = ngramjoin.ngram_components(frame(spark, ODD), 4, 85, 100).collect()
    assert len(got) == len(ODD)
    assert ngramjoin.ngram_components(frame(spark, []), 4, 85, 100).count() == 0


def test_cells_hold_every_pair_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_ROWS", 4)
    texts = family(70, 60, 5)
    some = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.ngram_components(frame(spark, some), 4, 85, 100).collect()}
    assert got == brute_components(word_sets(some, 4), 85, 100)


def line_sets(rows):
    out = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r").encode())
            if raw:
                out[d, i] = frozenset(raw[j : j + 4] for j in range(max(1, len(raw) - 3)))
    return out


def test_kept_lines_equal_all_pairs(spark):
    base = ["The quick brown fox jumps over the lazy dog near the old river bank today.", "ab", "AB", "", "  ", "other words entirely"]
    near = [base[0].replace("dog", "cat"), base[0].upper(), base[0] + " ", base[0][:-1] + "!"]
    texts = ["\n".join([*base, *near]), base[0], None, "", "\n", "ab\nab\n", "x" * 5000, "x" * 5001, *family(12, 40, 3)]
    some = list(enumerate(texts))
    got = {tuple(r) for r in lines.kept_lines(frame(spark, some)).collect()}
    assert got == set(brute_components(line_sets(some), 80, 100).values())
    whole = {r["doc_id"]: r for r in lines.lines_per_document(frame(spark, some)).collect()}
    assert whole[1]["text"] == "" and whole[2]["text"] is None and whole[4]["n_removed"] == 0
    assert lines.kept_lines(frame(spark, [])).count() == 0


def edited_lines():
    """Lines of 30 to 120 bytes, each with a copy in which a character or a word is another."""
    draw = np.random.default_rng(11)
    out = []
    for size in range(30, 121, 6):
        for kind in ("character", "word"):
            words = ["".join(chr(c) for c in draw.integers(97, 123, 6)) for _ in range(20)]
            line = " ".join(words)[: size - 1] + "z"
            at = 14 if size < 60 else 35
            new = line[:at] + "#" + line[at + 1 :] if kind == "character" else line[: at - at % 7] + "#%&$+=" + line[at - at % 7 + 6 :]
            out.append((line, new, size, kind))
    return out


def test_query_links_short_edited_lines(spark, tmp_path):
    planted = edited_lines()
    some = [(2 * i + j, (a, b)[j]) for i, (a, b, _, _) in enumerate(planted) for j in (0, 1)]
    frame(spark, some).select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r["doc_id"] for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect() if r["n_removed"]}
    for i, (_, _, size, kind) in enumerate(planted):
        assert (2 * i + 1 in gone) == (size >= (39 if kind == "character" else 84)), (size, kind)


def test_kept_lines_of_edited_lines_equal_all_pairs(spark, rows):
    some = [(-1 - i, a + "\n" + b) for i, (a, b, _, _) in enumerate(edited_lines())] + rows[:40] + [(9000, "ab\nAB\nabc\nabcd\nabcde")]
    got = {tuple(r) for r in lines.kept_lines(frame(spark, some)).collect()}
    want = set(brute_components(line_sets(some), 80, 100).values())
    assert want <= got and len(got - want) <= 0.01 * len(want)  # bands may miss a pair at the threshold


def test_keys_of_many_lines_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_ROWS", 3)
    texts = family(60, 30, 5) + family(60, 12, 6)  # chains of edits around one line
    some = [(i // 3, t) for i, t in enumerate(texts)]
    some = [(d, "\n".join(t for e, t in some if e == d)) for d in sorted({d for d, _ in some})]
    got = {tuple(r) for r in lines.kept_lines(frame(spark, some)).collect()}
    want = set(brute_components(line_sets(some), 80, 100).values())
    assert want <= got and len(got - want) <= 0.02 * len(want)


def test_few_long_lines_are_compared_by_text(spark, monkeypatch):
    draw = np.random.default_rng(21)
    base = ["".join(chr(c) for c in draw.integers(97, 123, 7)) for _ in range(90)]
    # half of the words are those of every line: similar in part, and too long for a sketch of 256 bits
    texts = [" ".join([*base[:60], *("".join(chr(c) for c in draw.integers(97, 123, 7)) for _ in range(30))]) for _ in range(60)]
    some = list(enumerate([*texts, texts[0][:-1] + "#"]))
    asked = []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    for rows_ in (1 << 20, 50):
        monkeypatch.setattr(jaccard, "PART_ROWS", rows_)
        got = {tuple(r) for r in lines.kept_lines(frame(spark, some)).collect()}
        assert got == set(brute_components(line_sets(some), 80, 100).values()) and len(got) == 60
    assert sum(asked) <= 4


def test_fine_sketches_allow_every_similar_pair():
    draw = np.random.default_rng(22)
    sets = [draw.choice(4000, n, replace=False).astype(np.uint64) for n in (1, 5, 120, 130, 700, 800, 3000)]
    sets += [np.append(s[len(s) // 12 :], np.uint64(9000)) for s in sets]
    values, sizes = textblocks.mixed(np.concatenate(sets)), np.array([len(s) for s in sets])
    fine = jaccard._Fine(jaccard.fine_sketches(values, sizes))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = jaccard._may_be_similar(fine, i, fine, j, (sizes[i] + sizes[j]) * 20 / 180 + 1e-9)
    similar = [100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert got[similar].all() and sum(similar) > len(sets) and got.sum() < len(got) / 2


def test_fine_sketches_fold_to_coarse_ones_that_allow_every_similar_pair():
    draw = np.random.default_rng(23)
    sets = [draw.choice(4000, n, replace=False).astype(np.uint64) for n in (1, 5, 60, 120, 130, 700)]
    sets += [np.append(s[len(s) // 12 :], np.uint64(9000)) for s in sets]
    values, sizes = textblocks.mixed(np.concatenate(sets)), np.array([len(s) for s in sets])
    raw = jaccard.fine_sketches(values, sizes, 2)
    assert [len(v.as_py()) for v in raw][:6] == [32, 32, 32, 32, 64, 256]  # two bits a value, 256 bits at least
    coarse = np.column_stack(jaccard._Fine(raw).coarse())
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = np.bitwise_count(coarse[i] ^ coarse[j]).sum(axis=1)
    assert all(apart[k] <= len(np.setxor1d(sets[a], sets[b])) for k, (a, b) in enumerate(zip(i, j, strict=True)))


def test_cells_hold_a_member_once_where_one_block_does(spark, monkeypatch):
    live = spark.createDataFrame([(7, i, -1) for i in range(1, 9)], "key long, id long, pos int")
    labels = spark.createDataFrame([(2, 1), (1, 1)], "id long, label long")
    items = spark.createDataFrame([(i, 5, 0, 0, 0, 0, b"") for i in range(1, 9)], f"id long, size long, {jaccard.SKETCH_SCHEMA}, raw binary")
    cells = jaccard._cells(live, labels, items)
    assert sorted(r["id"] for r in cells.collect()) == [*range(1, 9)]
    assert not set(jaccard.SKETCH) & set(cells.columns) and "raw" in cells.columns
    monkeypatch.setattr(jaccard, "CELL_ROWS", 2)
    met = defaultdict(set)
    for r in jaccard._cells(live, labels, items).collect():
        met[r["x"], r["y"]].add(r["id"])
    pairs = {p for held in met.values() for p in itertools.combinations(sorted(held), 2)}
    assert pairs | {(1, 2)} == set(itertools.combinations(range(1, 9), 2))


def test_lines_alone_with_their_hub_do_not_meet_again(spark, monkeypatch):
    draw = np.random.default_rng(31)
    texts = ["".join(chr(c) for c in draw.integers(97, 123, 200)) for _ in range(20)]
    some = list(enumerate(texts + [t[:-1] + "#" for t in texts]))
    met, cells = [], jaccard._cells
    monkeypatch.setattr(jaccard, "_cells", lambda live, *rest: met.append(live.count()) or cells(live, *rest))
    got = {tuple(r) for r in lines.kept_lines(frame(spark, some)).collect()}
    assert got == set(brute_components(line_sets(some), 80, 100).values()) and len(got) == 20
    assert sum(met) == 0  # all keys have two members, a hub and one that met it


def test_members_of_a_key_keep_every_pair_that_sizes_allow(spark, monkeypatch):
    monkeypatch.setattr(lines, "_HELD", 7)
    draw = np.random.default_rng(32)
    rows_ = [(k, k * 1000 + i, int(n), int(draw.integers(2, 9))) for k in range(12) for i, n in enumerate(draw.integers(40, 400, 2 * k + 1))]
    frame_ = spark.createDataFrame(rows_, "key long, id long, size long, shared int")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        got = lines._members(frame_, 80, 100).collect()
    finally:
        spark.conf.set(limit, before)
    size = {i: n for _, i, n, _ in rows_}
    assert len(got) == sum(2 * k for k in range(12)) and all(size[r["id"]] == r["size"] and size[r["hub"]] == r["hub_size"] for r in got)
    for k in range(1, 12):
        own = [r for r in got if r["id"] // 1000 == k]
        best = min((-s, i) for x, i, _, s in rows_ if x == k)[1]
        assert {r["hub"] for r in own} == {best} and len(own) == 2 * k
        for a, b in itertools.combinations(own, 2):
            if 100 * min(a["size"], b["size"]) >= 80 * max(a["size"], b["size"]):
                assert a["chain"] is not None and a["chain"] == b["chain"]
    small = [r for r in got if r["id"] // 1000 < 3]
    assert len({r["chain"] for r in small if r["chain"] is not None}) + sum(r["chain"] is None for r in small) > 2


def test_repeated_keys_are_those_of_several_lines(spark):
    draw = np.random.default_rng(33)
    keys = draw.integers(0, 2**64 - 1, (50, lines.BANDS), dtype=np.uint64)
    keys[40:, :3] = keys[:10, :3]
    classes = spark.createDataFrame([(bytearray(k.tobytes()),) for k in keys], "bands binary")
    got = sorted(r["key"] for r in lines._repeated_keys(classes).collect())
    assert got == sorted(keys[:10, :3].astype(np.uint32).ravel().tolist())
    assert lines._repeated_keys(classes.limit(0)).count() == 0


def test_similar_lines_is_exact():
    draw = np.random.default_rng(8)
    lines_ = ["".join("abc"[i] for i in draw.integers(0, 3, n)) for n in draw.integers(1, 30, 400)]
    other = [x[:-1] + "z" if i % 2 else x[1:] or "q" for i, x in enumerate(lines_)]
    sets = [[frozenset(x[j : j + 4] for j in range(max(1, len(x) - 3))) for x in side] for side in (lines_, other)]
    want = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(*sets, strict=True)]
    got = lines.similar_lines(pa.array([x.encode() for x in lines_]), pa.array([x.encode() for x in other]), 80, 100)
    assert got.tolist() == want and 20 < sum(want) < 380


def test_banding_recall(spark, rows):
    sets = line_sets(rows)
    got = {tuple(r) for r in lines.kept_lines(frame(spark, rows)).collect()}
    by_shingle = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            by_shingle[g].add(k)
    lost = 0
    for k in got:  # a kept line has no earlier line near it, but for missed candidates
        near = Counter(x for g in sets[k] for x in by_shingle[g] if x < k)
        lost += any(100 * c >= 80 * (len(sets[k]) + len(sets[x]) - c) for x, c in near.items())
    assert lost <= 0.005 * len(got)


def test_contaminated(spark, small, rows):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    body = items[0][1]
    edited = [(900, "before " + body[:30] + "~" + body[31:60] + body[61:] + " after"), (901, body[: len(body) // 2]), (902, body.upper())]
    some = ODD + rows + edited
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, some), benchmark).collect()}
    plain = {i: " ".join(t.lower().split()) for i, t in items}
    want = {(d, i) for d, t in some for i, b in plain.items() if b in " ".join((t or "").lower().split())}
    assert want <= got and (900, items[0][0]) in got and (901, items[0][0]) not in got
    assert got - want == {(900, items[0][0])}
    left = decontaminate.clean(frame(spark, some), benchmark)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in some} - {d for d, _ in got}
    assert decontaminate.contaminated(frame(spark, ODD), benchmark.limit(0)).count() == 0


def test_alignment_counts_edits():
    def edits(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [row[0] + 1]
            for j, y in enumerate(b):
                now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
            row = now
        return min(row)

    draw = np.random.default_rng(3)
    for _ in range(200):
        a, b = (draw.integers(97, 100, n).astype(np.uint8) for n in (12, 16))
        hit = decontaminate.alignment(a, b, 6, 2)
        want = edits(a.tolist(), b.tolist())
        assert hit is None or hit[0] >= want
        assert want > 2 or hit[0] == want


def test_suffix_order():
    draw = np.random.default_rng(4)
    for size in (1, 2, 30, 400):
        for letters in (1, 2, 5):
            text = np.append(draw.integers(1, letters + 1, size), 0).astype(np.uint8)
            raw = text.tobytes()
            got = [raw[i : i + 50] for i in suffixes.suffix_order(text)]
            assert got == sorted(raw[i : i + 50] for i in range(len(raw)))


def test_without_repeats_equals_brute_force(spark, rows):
    passage = "".join(f"{i:03d}-" for i in range(40))
    texts = [t for _, t in ODD[:8]] + ["é" * 60, "aé" * 60, "a" * 200, "a" * 49, "a" * 50, passage, "x" + passage + "y" + passage, passage[3:53]]
    some = [(500 + i, t) for i, t in enumerate(texts)] + rows
    got = {r["doc_id"]: r for r in suffixes.without_repeats(frame(spark, some)).collect()}
    first = {}
    raw = {d: (t or "").encode() for d, t in some}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 49):
            first.setdefault(raw[d][i : i + 50], d)
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = len(re.findall(b"1+", bytes(48 + int(x) for x in gone)))
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(b), int(gone.sum()), spans), d
        assert hashlib.sha256(got[d]["remaining"]).digest() == hashlib.sha256(left).digest()
    assert suffixes.without_repeats(frame(spark, ODD)).count() == len(ODD)
    assert suffixes.without_repeats(frame(spark, [])).count() == 0


def test_the_bitmap_of_shared_keys_travels_compressed(spark, rows, monkeypatch):
    plain, made = suffixes._shared_keys, []

    def large(named, known, n_bytes):
        made.append(plain(named, known, 1 << 27))  # as for 128 MB of text: a bitmap of 32 MB
        return made[-1]

    want = {r["doc_id"]: r["n_removed"] for r in suffixes.without_repeats(frame(spark, rows)).collect()}
    monkeypatch.setattr(suffixes, "_shared_keys", large)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.without_repeats(frame(spark, rows)).collect()}
    assert got == want and sum(want.values()) > 0
    assert len(pickle.dumps(made[0])) < 1 << 20
    assert made[0].whole.nbytes == 1 << 25 and made[0].whole.any()


def test_hot_anchors_are_split_without_losing_windows(spark, rows, monkeypatch):
    draw = np.random.default_rng(12)

    def noise(n):
        return bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode()

    passage = noise(300)
    texts = [noise(60) + passage[i % 3 :] + noise(60) for i in range(120)] + [passage[100:180], passage + passage, "é" * 60, "a" * 200]
    some = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(2000 + d, t) for d, t in rows[:60]]
    largest = []
    removed = suffixes._removed

    def counted(dealt):
        largest.append(max(r["count"] for r in dealt.groupBy("key").count().collect()))
        return removed(dealt)

    monkeypatch.setattr(suffixes, "_removed", counted)
    monkeypatch.setattr(suffixes, "HOT_ROWS", 40, raising=False)
    got = {r["doc_id"]: r for r in suffixes.without_repeats(frame(spark, some).repartition(8)).collect()}
    raw = {d: t.encode() for d, t in some}
    first = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 49):
            first.setdefault(raw[d][i : i + 50], d)
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        assert got[d]["n_removed"] == int(gone.sum()) and got[d]["remaining"] == np.frombuffer(b, np.uint8)[~gone].tobytes(), d
    assert largest[0] <= 40


def test_forward_pass_of_many_parts_equals_the_search_of_each():
    pieces = nbest.Pieces(MODEL)
    texts = ["the quick brown fox", "antidisestablishmentarianism", "日本語 x😀é", "\n", "   a", "a" * 48, "zz" * 20, "1234 5.6"]
    parts = list(dict.fromkeys(p for t in texts for p in nbest.parts_of(t)))
    ids, counts, best, gaps = pieces.forward(parts)
    ends = np.cumsum(counts)
    for part, end, count, score, gap in zip(parts, ends, counts, best, gaps, strict=True):
        found = pieces.nbest(part, 2)
        assert score == pytest.approx(found[0][0])
        assert gap == pytest.approx(found[0][0] - found[1][0] if len(found) > 1 else np.inf)
        if gap > 1e-9:
            assert tuple(ids[end - count : end].tolist()) == found[0][1]


def test_nbest_equals_all_segmentations():
    pieces = nbest.Pieces(MODEL)

    def every(text):
        if not text:
            yield 0.0, ()
            return
        for to in range(1, min(len(text), pieces.longest) + 1):
            head = text[:to]
            if head in pieces.score:
                found = (pieces.number[head],), pieces.score[head]
            elif to == 1:
                found = pieces._missing(head)
            else:
                continue
            for s, ids in every(text[to:]):
                yield found[1] + s, found[0] + ids

    search = nbest.Segmenter(MODEL, 4)
    for text in ("a", "the thin", "é 漢\nx", "aaa", "  ", "in  on "):
        ids, sizes, best = search(["other words", text])
        whole = nbest.BLANK + text.replace(" ", nbest.BLANK)
        want = sorted((s for s, _ in every(whole)), reverse=True)[:4]
        assert [s for s, _ in best[1]] == pytest.approx(want)
        valid = {i for _, i in every(whole)}
        for _, changes in best[1]:
            out = ids[sizes[0] :].tolist()
            for at, n, instead in sorted(changes, reverse=True):
                out[at : at + n] = instead
            assert tuple(out) in valid


def test_encode_and_decode(spark, rows):
    some = frame(spark, ODD + rows)
    coded = nbest.encode(some, MODEL, 2, F.col("doc_id"), F.col("text"))
    back = nbest.decode(coded.drop("nbest"), MODEL).collect()
    assert len(back) == len(ODD) + len(rows)
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert nbest.encode(frame(spark, []), MODEL, 2, F.col("doc_id")).count() == 0


def exact_neighbours(vectors, k):
    out = {}
    for q, v in vectors:
        if q % 100 == 0:
            found = sorted((math.dist(v, w), i) for i, w in vectors if i != q)[:k]
            out[q] = found
    return out


def test_neighbours(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = exact_neighbours(vectors, 10)
    got = neighbours.nearest_neighbours(table).collect()
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["vec_id"]] = r["score"]
    right = sum(i in found[q] for q, near in want.items() for _, i in near)
    assert right >= 0.9 * sum(map(len, want.values()))
    place = dict(vectors)
    assert all(s == pytest.approx(math.dist(place[q], place[i])) for q, near in found.items() for i, s in near.items())


def test_a_search_meets_few_nodes_and_finds_them(spark):
    draw = np.random.default_rng(12)
    middle = draw.normal(size=(30, 24)) * 2
    points = (middle[draw.integers(0, 30, 6000)] + draw.normal(size=(6000, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest_neighbours(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = points.astype(np.float64)
    right = 0
    for q in range(0, 6000, 100):
        d = ((exact - exact[q]) ** 2).sum(1)
        d[q] = np.inf
        right += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 60 and right >= 0.97 * 600


def test_a_search_carries_its_beam_and_not_all_it_met(spark, monkeypatch):
    n, written = 14, []
    cut = neighbours.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    nodes = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "node long, v array<double>")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "node long, to long")
    queries = spark.createDataFrame([(0, [0.0])], "query long, q array<double>")
    start = spark.createDataFrame([(0, n - 1)], "query long, node long")
    found = neighbours.greedy_search(nodes, links, queries, start, beam=2)
    assert {tuple(r) for r in found.collect()} == {(0, 0), (0, 1)}
    assert sum(written) <= 4 * n  # along a chain: the beam and the one node met in each round


def test_two_vectors_of_one_id_are_two_nodes(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 5.0]), (100, [0.0, 5.5]), (2, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r)[1:] for r in neighbours.nearest_neighbours(table).orderBy("rank").collect()]
    assert [(r, v, round(s, 3)) for r, v, s in got] == [(1, 1, 0.5), (2, 2, 5.099), (3, 1, 5.59)]


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 2.0]), (8, None), (9, [0.0, 0.0]), (10, [nan, 1.0]),
            (11, [inf, 1.0]), (12, [None, 1.0]), (13, [1.0]), (None, [3.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = [tuple(r) for r in neighbours.nearest_neighbours(table).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 5), (0, 2, 100), (0, 3, 7), (100, 1, 0), (100, 2, 5), (100, 3, 7)]
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    one = table.where("vec_id = 0")
    assert neighbours.nearest_neighbours(one).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, " 12 ", "en", "s", 4), (9003, "", None, None, None)], DOCS)
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(extra), small)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, small)
    assert 0 < out.count() <= docs.count()
    assert out.where("not round_trip").count() == 0


def test_pipeline_stages_equal_plain_versions(spark, small):
    import corpus_pipeline

    benchmark = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    words = [f"w{i}x{i * i}" for i in range(60)]
    texts = {
        1: " ".join(words), 2: " ".join(words[:59]) + " end", 3: " ".join(words[:30]), 4: " ".join(words).upper(), 5: "short one",
        6: "short one", 7: "before " + benchmark[0] + " after", 8: benchmark[1].upper(), 9: benchmark[2][:-1] + "~", 10: "12 34", 11: None, 12: "",
    }
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts.items()], DOCS)
    # nothing to learn from: only texts without a letter go
    kept = corpus_pipeline.keep_known_languages(spark, docs, small)
    assert {r["doc_id"] for r in kept.collect()} == set(range(1, 10))
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    linked = brute_components({i: s for i, s in sets.items() if s}, 80, 100)
    want = {i for i in texts if linked.get(i, i) == i}
    one = corpus_pipeline.keep_one_of_similar(spark, docs, small)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == want and want >= {1, 3, 5} and not want & {2, 4, 6}
    clean = corpus_pipeline.drop_contaminated(spark, docs, small)
    plain = [" ".join(b.lower().split()) for b in benchmark]
    held = {i for i, t in texts.items() if any(b in " ".join((t or "").lower().split()) for b in plain)}
    assert held == {7, 8} and {r["doc_id"] for r in clean.collect()} == set(texts) - held - {9}  # 9 has one edit
    lines_ = spark.createDataFrame([(1, "one line that stays here\n\nanother long line of this text", "en", "s", 9), (2, "Another long line of this text \nnew", None, None, None), (3, "ONE LINE that stays here", "en", "s", 1), (4, None, "en", "s", 1)], DOCS)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, lines_, small).collect()}
    assert left == {1: "one line that stays here\n\nanother long line of this text", 2: "new"}
    pieces_ = {r["doc_id"]: r for r in corpus_pipeline.to_pieces(spark, docs, small).collect()}
    assert set(pieces_) == set(texts) and all(r["round_trip"] for r in pieces_.values())


def test_pieces_keep_the_best_segmentations(spark, small):
    import corpus_pipeline

    docs = frame(spark, [(1, "the water of the rural fund"), (2, None)])
    got = {r["doc_id"]: r for r in corpus_pipeline.to_pieces(spark, docs, small).collect()}
    assert len(got[1]["nbest"]) == 4 and got[1]["nbest"][0]["score"] == got[1]["score"]
    assert len(got[2]["nbest"]) == 1 and got[2]["round_trip"]


def test_kept_parts_are_bound_by_their_bytes(monkeypatch):
    texts = [f"line {i} of the minister's water fund" for i in range(60)]
    usual = nbest.Segmenter(MODEL, 3)
    want = [usual([t]) for t in texts]
    monkeypatch.setattr(nbest, "_AT_ONCE", 8)
    bound = nbest.Segmenter(MODEL, 3, kept=4_000)
    for text, (ids, sizes, best) in zip(texts, want, strict=True):
        got = bound([text])
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == sizes.tolist() and got[2] == best
        assert bound.taken < 4_000 + 100 * 300
    assert len(bound.place) < len(usual.place)


def test_every_operator_has_a_query():
    numbers = Counter(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == Counter(range(1, 14))


def test_batches_are_cut_without_losing_rows():
    from harrow.llm.textblocks import pieces

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 100, 3, 3)]})
    assert [p.num_rows for p in pieces([batch], limit=10)] == [2, 1, 2]


def test_workers_hold_no_parts_of_an_ended_task(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma") for i in range(64)], "doc_id long, text string").repartition(4)
    assert nbest.encode(docs, model, 2, F.col("doc_id")).where("n_pieces > 0").count() == 64

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(nbest.segmenter(model, 2).place)], pa.int64())})

    assert {r["n"] for r in spark.range(0, 64, 1, 4).mapInArrow(held, "n long").collect()} == {0}
