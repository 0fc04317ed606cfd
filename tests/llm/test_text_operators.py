import hashlib
import math
import re
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.llm.words import Block, span_hash
from tallyglass.llm import cost_packing, curriculum_mix, jaccard_join, line_chunks, queries, robust_outliers, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def jaccard_classes(rows):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall(lower(text))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    pairs = {(v[0], x) for v in where.values() for x in v[1:]} | {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        both = len(x & y)
        if 100 * both >= 75 * (len(x) + len(y) - both):
            i, j = find(sets[a][0]), find(sets[b][0])
            root[max(i, j)] = min(i, j)
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_jaccard_join_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in jaccard_join.near_duplicate_classes(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_classes(rows)


def test_jaccard_join_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in rng.integers(0, 500, 200)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 200, 4):
            words[at] = f"u{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_classes(rows)


def test_jaccard_join_long_postings_in_tiles(spark, monkeypatch):
    """Different documents around one shared passage: long postings with many components, met in tiles."""
    monkeypatch.setattr(jaccard_join, "POSTING_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PAIRS_TOGETHER", 50)
    shared = [f"s{i}" for i in range(60)]
    rows = [(f"d{i:03}", " ".join([*shared, *(f"u{i // 2}_{k}" for k in range(18 + i % 5))])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicate_classes(docs).collect())
    assert got == jaccard_classes(rows)


@pytest.mark.parametrize("block", [1 << 19, 4_000])
def test_jaccard_join_cross_pairs_stay_packed(spark, monkeypatch, block):
    """Copies of one text, many too far apart to link: all pairs are candidates, but rows follow the documents."""
    made = []

    def counting(*args):
        out = shared.cut(cross(*args))
        made.append(out.count())
        return out

    cross = jaccard_join._cross_pairs
    monkeypatch.setattr(jaccard_join, "_cross_pairs", counting)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block, raising=False)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 1_000, raising=False)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 20_000, raising=False)
    rng = np.random.default_rng(3)
    base, rows = [f"t{i}" for i in range(120)], []
    for i in range(200):
        words = list(base)
        at = int(rng.integers(0, 80))
        words[at : at + 4 + i % 20] = [f"u{i}_{k}" for k in range(4 + i % 20)]
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_classes(rows)
    assert len({c for _, _, c in got}) > 20
    assert made and 0 < made[0] <= 200 * -(-200 * 116 // block)


def test_jaccard_join_long_posting_is_counted_in_lots(spark, monkeypatch):
    """A task that meets postings of many components holds one lot of their pairs, and hands on few pairs twice."""
    steps, n = {}, 1500
    grouped = type(spark.range(1).groupBy("id"))
    apply = grouped.applyInPandas
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, f, schema: apply(self, steps.setdefault(f.__name__, f), schema))
    monkeypatch.setattr(jaccard_join, "PAIRS_TOGETHER", 50_000)
    entries = spark.createDataFrame([(fp, i, 100, 8, i) for fp in (1, 2) for i in range(4)], "fp long, id long, size int, need int, comp long")
    assert jaccard_join._cross_pairs(entries, 75, 4, 1).count() == 0  # eight must be shared
    ids = np.tile(np.arange(n), 2)
    frame = pd.DataFrame({"c0": 0, "x": 0, "y": 0, "fp": np.repeat([1, 2], n), "part": 0, "id": ids, "comp": ids, "size": 100, "need": 8, "home": 0})
    tracemalloc.start()
    try:
        out = steps["meet"]((0,), frame)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n * (n - 1) // 2 <= out["n"].sum() < 1.1 * n * (n - 1) / 2
    assert peak < 32 << 20


def test_one_of_each(odd):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10]


def test_one_of_each_null_ids_and_repeated_rows(spark):
    body, other, third = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = " ".join([*body.split()[:59], "end"])
    rows = [
        (None, "only here and nowhere else at all", "x"),
        (None, "", "x"),
        (None, " ", "x"),
        (None, near, "x"),
        (3, body, "x"),
        (3, body, "x"),
        (3, other, "x"),  # another text of the same id
        (5, body, "x"),
        (7, "", "x"),
        (7, "", "x"),
        (None, third, "x"),
        (None, third, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    got = jaccard_join.one_of_each(docs).collect()
    expected = [rows[i] for i in (0, 1, 2, 4, 6, 8, 10)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_jaccard_join_links_through_null_ids_and_shared_ids(spark):
    words = [f"w{i}" for i in range(100)]
    change = lambda n: " ".join([*(f"v{i}" for i in range(n)), *words[n:]])
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(4, change(0)), (None, change(8)), (9, change(16)), (9, other), (12, other), (None, "alone in all this table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard_join.near_duplicate_classes(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(4, 4), (None, 4), (9, 4), (9, 4), (12, 4), (None, None)]))


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    found = defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i : i + 8])].append(i)
    covered = {k for v in found.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_outlier_base_counts(which, request):
    docs = request.getfixturevalue(which)
    texts = docs.select("doc_id", "text").toPandas().drop_duplicates("doc_id").set_index("doc_id").text
    out = robust_outliers.quality_outliers(docs).toPandas()
    assert len(out) == docs.count()
    for r in out.itertuples():
        expected = base_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)


def plain_features(text):
    text = text or ""
    n_words, chars, symbols, dup, repeats = base_counts(text)
    words, chars = max(n_words, 1), max(chars, 1)
    count = lambda pattern: len(re.findall(pattern, text))
    marks = sum(text.count(c) for c in "!?.,;:\"'()[]{}-_+=/\\@^~`")
    return [
        math.log(chars / words),
        math.log1p(20 * symbols / words),
        math.sqrt(min(12 * dup / words, 1)),
        math.sqrt(repeats / words),
        math.log1p(10 * count("[A-Z]") / chars),
        math.log1p(5 * marks / words),
        math.log1p(20 * count("[0-9]") / chars),
    ]


def plain_distances(z, groups, min_group):
    """Distances by a plain minimum covariance determinant: three starts, three steps, the least determinant."""
    d, floors = z.shape[1], np.diag(np.square(robust_outliers.FLOORS))
    rank = lambda v, share: np.sort(v)[max(0, math.ceil(share * len(v)) - 1)]

    def limit(dist, share):
        return np.exp((np.floor(np.log(rank(dist, share) + 1e-9) * robust_outliers.BINS) + 1) / robust_outliers.BINS)

    def far(x, mean, inverse):
        return np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)

    def estimate(x):
        cov = np.cov(x.T, bias=True) + floors
        return x.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def model(x):
        low, mid, high = (np.array([rank(c, q) for c in x.T]) for q in (0.25, 0.5, 0.75))
        first = mid, np.diag(1 / np.maximum((high - low) / 1.349, robust_outliers.FLOORS) ** 2)
        near = far(x, *first)
        starts = [first, estimate(x)[:2], estimate(x[near <= limit(near, 0.5)])[:2]]
        found = []
        for mean, inverse in starts:
            for _ in range(3):
                dist = far(x, mean, inverse)
                mean, inverse, det = estimate(x[dist <= limit(dist, 0.75)])
            found.append((det, len(found), mean, inverse))
        _, _, mean, inverse = min(found, key=lambda f: f[:2])
        return mean, inverse, max(limit(far(x, mean, inverse), 0.5) / robust_outliers.chi_square(d, 0.0), 0.05)

    every, out = model(z), np.zeros(len(z))
    for g in set(groups):
        mine = np.array([k == g for k in groups])
        mean, inverse, scale = model(z[mine]) if mine.sum() >= min_group else every
        out[mine] = np.sqrt(far(z[mine], mean, inverse) / scale)
    return out


def test_outlier_verdict_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 20000")
    docs = docs.selectExpr("doc_id", "text", "lang", "if(doc_id % 9 = 0, source, null) as source")
    frame = docs.toPandas()
    groups = list(zip(frame.lang, frame.source))
    assert {len([g for g in groups if g == k]) >= 60 for k in set(groups)} == {True, False}
    expected = plain_distances(np.array([plain_features(t) for t in frame.text]), groups, 60)
    out = robust_outliers.quality_outliers(docs).toPandas().set_index("doc_id").loc[frame.doc_id]
    close = np.isclose(out.distance, expected, rtol=1e-3)
    assert close.mean() > 0.999
    assert (out.kept.to_numpy() == (~out.base_failed.to_numpy() & (expected <= robust_outliers.CUTOFF)))[close].all()


def test_outlier_junk_alone_in_its_group_is_rejected(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "house", "winter", "table", "green"]
    prose = lambda: " ".join(rng.choice(words, 60)).capitalize() + f". {rng.integers(100)}"
    junk = " ".join(f"#{i}$%&*|" for i in range(60))
    rows = [(i, prose(), "en", "a") for i in range(150)] + [(900, junk, "en", "a"), (901, junk, "xx", "only"), (902, prose(), "*", "*"), (None, prose(), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in robust_outliers.quality_outliers(docs).collect()}
    assert not kept[900] and not kept[901] and kept[902] and kept[None]
    assert sum(kept.values()) >= 145
    named = docs.selectExpr("*", "1 as tg_lang", "2 as tg_text", "3 as tg_starts", "4 as tg_row", "5 as tg_own", "6 as tg_id", "7 as tg_hash")
    out = robust_outliers.keep_quality(named)
    assert out.columns == named.columns and out.count() == sum(kept.values())
    out = line_chunks.drop_repeated_lines(named)
    assert out.columns == named.columns and out.count() == named.count()
    out = jaccard_join.one_of_each(named)
    assert out.columns == named.columns and out.count() == 150 + 1 + 2
    out = curriculum_mix.training_order(named)
    assert out.columns == named.columns and out.count() > 0
    assert cost_packing.pack(named, queries.tokenizer_file()).where("start = 0").count() == named.count()


def test_outlier_stage_keeps_columns(odd, nothing):
    assert robust_outliers.keep_quality(odd).columns == odd.columns
    assert robust_outliers.keep_quality(nothing).count() == 0
    assert robust_outliers.quality_outliers(nothing).count() == 0


def same(left, right):
    right = right[left.columns]
    key = list(left.columns)
    left, right = (x.sort_values(key, ignore_index=True) for x in (left, right))
    pd.testing.assert_frame_equal(left, right, check_dtype=False)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix_equals_sql(which, request):
    docs = request.getfixturevalue(which)
    got = curriculum_mix.mix_report(docs).toPandas()
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toArrow())
    same(got, db.sql(curriculum_mix.ORACLE_SQL).df())
    assert (got.taken <= 3 * got["size"]).all()


def test_mix_stage(documents, odd, nothing):
    report = curriculum_mix.mix_report(documents).toPandas()
    out = curriculum_mix.training_order(documents)
    assert out.columns == documents.columns
    times = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    expected = report[report.taken > 0].set_index("doc_id")
    assert (times.sort_index() == (expected.taken // expected["size"]).sort_index()).all()
    assert curriculum_mix.training_order(nothing).count() == 0
    assert curriculum_mix.training_order(odd).columns == odd.columns


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_packing_round_trip(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    if which == "odd":
        docs = docs.dropDuplicates(["doc_id"])
    path = queries.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    out = cost_packing.pack(docs, path).toPandas()
    assert set(out.doc_id) == set(texts.index)
    for doc_id, pieces in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (pieces.doc_tokens == len(ids)).all()
        assert pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        assert pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 4096


def test_packing_repeated_rows_and_empty(odd, nothing):
    out = cost_packing.pack(odd, queries.tokenizer_file()).toPandas()
    assert out.loc[out.doc_id == 2, "length"].sum() == 2 * out.loc[out.doc_id == 2, "doc_tokens"].iat[0]
    assert cost_packing.pack(nothing, queries.tokenizer_file()).count() == 0


def test_packing_pads_little_and_keeps_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(cost_packing, "REPEATS", 3)
    monkeypatch.setattr(cost_packing, "GROUP_BYTES", 60_000)
    big = 9007199254740993
    rows = [(None, "one two"), (big, "one two"), (big + 2, "three"), (None, None)] + [(7, "same row again")] * 500
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    out = cost_packing.pack(docs, queries.tokenizer_file())
    assert {r.doc_id for r in out.collect()} >= {None, big, big + 2}
    assert out.where("doc_id = 7 and start = 0 and length = doc_tokens").count() >= 450
    assert out.where("start = 0").count() == docs.count()
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    groups = out.select(F.expr(f"sequence_id div {cost_packing.SEQUENCES}").alias("g")).distinct().count()
    total = per.agg(F.sum("n").alias("n"), F.count("n").alias("c")).first()
    assert total.c * 4096 - total.n < groups * 4096  # less than one sequence a group
    again = cost_packing.pack(docs.repartition(5), queries.tokenizer_file())
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))


def test_packing_string_ids(spark):
    docs = spark.createDataFrame([("a", "one"), (None, "two")], "doc_id string, text string")
    assert sorted(repr(r.doc_id) for r in cost_packing.pack(docs, queries.tokenizer_file()).collect()) == ["'a'", "None"]


def lines_of(text):
    """(start, end) in bytes of every line of a text."""
    out, at = [], 0
    for line in (text or "").encode().split(b"\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out if out[-1][0] < len((text or "").encode()) else out[:-1]


def bounds_of(raw, lines, level):
    """First lines of the chunks of a level, gap by gap."""
    from tallyglass.llm.words import mix, ngram_hash

    seed, behind = level
    keys = [span_hash(Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).prefix_hash(), np.array([a]), np.array([b]))[0] for a, b in lines]
    firsts = {0}
    for i in range(len(lines) - 1):
        if int(mix(ngram_hash(np.array(keys[i : i + 2]), 2) + np.uint64(seed))[0]) % line_chunks.DIVISOR == 0:
            firsts.add(i + behind)
    firsts = sorted(f for f in firsts if f < len(lines))
    return sorted({k for f, stop in zip(firsts, [*firsts[1:], len(lines)]) for k in range(f, stop, line_chunks.MAX_LINES)})


def chunk_brute(rows):
    """What is left when later copies of chunks go, and how many lines went."""
    seen, left = {}, {}
    every = []
    for doc_id, text in rows:
        raw, lines, spans = (text or "").encode(), lines_of(text), set()
        for level in line_chunks.LEVELS if lines else []:
            firsts = bounds_of(raw, lines, level)
            spans |= {(f, stop - 1) for f, stop in zip(firsts, [*firsts[1:], len(lines)]) if stop - f > 1}
        every += [(doc_id, lines[f][0], lines[n][1], raw[lines[f][0] : lines[n][1]]) for f, n in spans]
        left[doc_id] = (raw, lines, set())
    for doc_id, a, b, body in sorted(every):
        first = seen.setdefault(body, (doc_id, a, b))
        if first != (doc_id, a, b):
            a = max(a, first[2]) if first[0] == doc_id else a
            left[doc_id][2].update(x for x, _ in left[doc_id][1] if a <= x < b)
    out = {}
    for doc_id, (raw, lines, gone) in left.items():
        edges = [x for x, _ in lines] + [len(raw)]
        out[doc_id] = (len(gone), b"".join(raw[a:b] for a, b in zip(edges, edges[1:]) if a not in gone))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_line_chunks_equal_brute_force(which, request):
    docs = request.getfixturevalue(which).dropDuplicates(["doc_id"])
    expected = chunk_brute([(r.doc_id, r.text) for r in docs.collect()])
    out = line_chunks.line_report(docs).toPandas()
    got = {r.doc_id: (r.n_removed_lines, r.kept_sha256) for r in out.itertuples()}
    assert got == {d: (n, hashlib.sha256(t).hexdigest()) for d, (n, t) in expected.items()}


@pytest.mark.parametrize("size,least", [(4, 0.5), (8, 0.85), (20, 0.95)])
def test_line_chunks_find_planted_passages(size, least, spark):
    """Passages at other places in every document: the later copies' lines go, most of short passages, all of long ones."""
    rows, planted = [], set()
    for k in range(30):
        passage = [f"passage {size} {k} line {i}" for i in range(size)]
        planted |= set(passage)
        rows += [(d, "\n".join([f"own {d} {i}" for i in range(1 + d % 7)] + passage + [f"end {d} {i}" for i in range(d % 5)])) for d in (2 * k, 2 * k + 1)]
    rows.append((99, "x\nx\nx\nx\ny"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: (r.text or "").split("\n") for r in line_chunks.drop_repeated_lines(docs).collect()}
    assert all(planted & set(kept[2 * k]) == {x for x in planted if x.startswith(f"passage {size} {k} ")} for k in range(30))
    stayed = sum(len(planted & set(kept.get(2 * k + 1, []))) for k in range(30))
    assert 1 - stayed / (30 * size) >= least
    assert all([x for x in kept[d] if x and x not in planted] == [x for x in t.split("\n") if x not in planted] for d, t in rows if d in kept and d < 99)


def test_line_chunk_bounds_come_from_content():
    """The same lines behind other ones are cut at the same places, and not everywhere."""
    rng = np.random.default_rng(2)
    body, before = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 5).astype(np.uint64)
    for level in line_chunks.LEVELS:
        alone = line_chunks.chunk_bounds(body, np.zeros(400, np.int64), level)
        later = line_chunks.chunk_bounds(np.concatenate([before, body]), np.zeros(405, np.int64), level) - 5
        assert set(alone[alone > 20]) == set(later[later > 20])
        assert 100 < len(alone) < 300


def test_line_chunks_survive_shift(odd):
    out = line_chunks.line_report(odd).toPandas().set_index("doc_id")
    assert out.n_removed_lines[11] > 10
    kept = line_chunks.drop_repeated_lines(odd)
    assert kept.columns == odd.columns


def test_line_chunks_empty(nothing):
    assert line_chunks.line_report(nothing).count() == 0


def test_mix_null_ids(spark):
    rows = [(None, "one two three", "a"), (None, "four", "a"), (None, None, "a"), (None, "five six", None), (3, "seven", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum_mix.mix_report(docs).toPandas()
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    plain = ["size", "source_size", "target", "taken"]
    same(got[plain], db.sql(curriculum_mix.ORACLE_SQL).df()[plain])
    assert got.doc_id.isna().sum() == 4


def test_pipeline_rows_equal_brute_force(spark, sf, documents):
    """Every stage on what the one before kept, row by row."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: shared.cut(stages[name](spark, docs, sf))
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}

    frame = documents.toPandas()
    assert frame.doc_id.is_unique
    far = plain_distances(np.array([plain_features(t) for t in frame.text]), list(zip(frame.lang, frame.source)), 60)
    counts = [base_counts(t) for t in frame.text]
    failed = np.array([c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts])
    clear = np.abs(far - robust_outliers.CUTOFF) > 0.01
    stays = ~failed & (far <= robust_outliers.CUTOFF)
    docs = run("quality_rules", documents)
    kept = texts(docs)
    assert all((d in kept) == s for d, s, c in zip(frame.doc_id, stays, clear) if c or not s)
    before = texts(documents)
    assert kept == {d: before[d] for d in kept} and 0 < len(kept) < len(before)

    expected = {d: t.decode() for d, (_, t) in chunk_brute(sorted(kept.items())).items()}
    expected = {d: t for d, t in expected.items() if t or not kept[d]}  # what is left without a line goes
    docs = run("line_dedup", docs)
    assert texts(docs) == expected

    classes = jaccard_classes(sorted(expected.items()))
    docs = run("ngram_jaccard_join", docs)
    first = {c for _, _, c in classes}
    left = texts(docs)
    assert left == {d: expected[d] for d in first}

    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toArrow())
    plan = db.sql(curriculum_mix.ORACLE_SQL).df()
    docs = run("source_mixing", docs)
    times = docs.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert times == {int(d): int(t // n) for d, t, n in zip(plan.doc_id, plan.taken, plan["size"]) if t > 0}

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    out = run("packing", docs).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()
    tokens = {d: len(tokenizer.encode(left[d], add_special_tokens=False).ids) + 1 for d in times}
    assert out.groupby("doc_id").length.sum().to_dict() == {d: n * tokens[d] for d, n in times.items()}
    assert (out.doc_tokens == out.doc_id.map(tokens)).all()
