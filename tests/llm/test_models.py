import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyglass.llm import attention_lm, attention_net, byte_cnn, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LM_FILE = queries.tokenizer_file("byte_bpe_50k.json")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_lm_base_equals_brute_force(which, request, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 4)
    monkeypatch.setattr(attention_lm, "HEAD", 50)  # most words take the way through the buckets
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, WORD.findall(lower(t)) + ["\n"]) for i, t in rows]
    c = Counter()
    for i, words in tokens:
        if not held(i):
            c.update(words)
    n, v = sum(c.values()), len(c)
    expected = sorted((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in tokens)
    out = attention_lm.text_scores(docs, LM_FILE).toPandas()
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.itertuples())
    assert got == expected
    assert (out.score < 0).all() and np.isfinite(out.score).all()


def test_lm_empty(nothing):
    assert attention_lm.text_scores(nothing, LM_FILE).count() == 0


def test_lm_learns_small_tables_as_large_ones(documents, monkeypatch):
    """Each piece of a table of any size is learned in one of the rounds."""
    dealt, met = attention_lm.dealt, []
    monkeypatch.setattr(attention_lm, "STEPS", 1)
    monkeypatch.setattr(attention_lm, "dealt", lambda *a: met.append(dealt(*a)) or met[0])
    attention_lm.text_scores(documents, LM_FILE)
    turns = met[0].toPandas().turn
    assert turns.notna().all() and turns.nunique() == len(attention_lm.ROUNDS)


@pytest.mark.parametrize("apart", [False, True])
def test_lm_learns_every_training_symbol(apart, documents, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 1)
    monkeypatch.setattr(attention_lm, "PIECE", 10 * attention_net.SCORED)
    rows = documents.selectExpr("doc_id as row", "doc_id", "doc_id % 3 <> 0 as training", "text")
    gathered = attention_lm.gather(rows, LM_FILE, 1).cache()
    all_rows = gathered.where("kind = 3").toPandas()
    symbols = lambda f: attention_lm.decoded(pa.array(f["a"], pa.binary()), f["n"].to_numpy())
    whole = {r: symbols(f).tolist() for r, f in all_rows.groupby("bucket")}
    assert set(whole) == {r.row for r in rows.where("training").collect()}
    parts = attention_lm.dealt(gathered, 3, apart).toPandas()
    assert parts.n.max() <= attention_lm.PIECE and parts.shard.nunique() == 3
    assert parts.turn.nunique() == (len(attention_lm.ROUNDS) if apart else 0)
    assert {r: symbols(f.sort_values("place")).tolist() for r, f in parts.groupby("row")} == whole

    met = []
    plain = attention_net.gradients

    def watched(w, ids, targets, live, *more):
        met.append(targets[live])
        return plain(w, ids, targets, live, *more)

    monkeypatch.setattr(attention_net, "gradients", watched)
    slots = np.minimum(np.arange(attention_lm.SYMBOLS), attention_net.RARE)
    w = attention_net.start_weights(np.ones(attention_net.SLOTS), 1.0, 1.0)
    mine = parts[parts.shard == 0]
    attention_lm._step(0, 0.01, SimpleNamespace(value=w), slots)((0,), mine)
    seen, due = (np.bincount(v, minlength=attention_net.RARE + 1) for v in (np.concatenate(met), slots[symbols(mine)]))
    assert (seen >= due).all() and seen.sum() <= due.sum() + attention_lm.BATCH * attention_net.SCORED


def plain_score(w, symbols, slots, inner):
    """log10 probability of a document's symbols, position by position, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    seq = [attention_net.START] * (attention_net.CONTEXT + 1) + [int(slots[s]) for s in symbols]
    total = 0.0
    for i, symbol in enumerate(symbols):
        begin = i - i % attention_net.SCORED  # first scored place of the window, which reads CONTEXT symbols before
        seen = seq[begin : i + attention_net.CONTEXT + 1]
        x = np.array([w["in"][s] + w["place"][k] for k, s in enumerate(seen)])
        e = (x @ w["k"]) @ (x[-1] @ w["q"]) / math.sqrt(attention_net.WIDTH)
        a = np.exp(e - e.max())
        h = x[-1] + (a / a.sum()) @ (x @ w["v"]) @ w["o"]
        z = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        slot = int(slots[symbol])
        logits = z @ w["class"] + w["class_bias"]
        group = slot // attention_net.MEMBERS if slot < attention_net.SLOTS else attention_net.CLASSES + slot - attention_net.SLOTS
        total += logits[group] - np.log(np.exp(logits).sum())
        if slot < attention_net.SLOTS:
            logits = z @ w["member"][group] + w["member_bias"][group]
            total += logits[slot % attention_net.MEMBERS] - np.log(np.exp(logits).sum())
        else:
            total += inner[symbol] * math.log(10)
    return total / math.log(10)


def test_lm_score_equals_plain_scores(documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(attention_lm, "STEPS", 6)
    got, fit = {}, attention_lm.fit
    monkeypatch.setattr(attention_lm, "fit", lambda pieces, slots, *more: got.update(slots=slots, w=fit(pieces, slots, *more)) or got["w"])
    out = attention_lm.text_scores(documents, LM_FILE).toPandas().set_index("doc_id").score
    w, slots = attention_net.views(got["w"]), got["slots"]
    tokenizer = Tokenizer.from_file(LM_FILE)
    tokenizer.encode_special_tokens = True
    texts = documents.select("doc_id", "text").toPandas().set_index("doc_id").text
    coded, counts = {}, np.zeros(attention_lm.SYMBOLS)
    for doc_id, text in texts.items():
        ids = []
        for word in WORD.findall(lower(text)):
            first, *rest = tokenizer.encode(word, add_special_tokens=False).ids
            ids += [first + attention_lm.IDS, *rest]
        coded[doc_id] = [*ids, attention_lm.END]
        if zlib.crc32(str(doc_id).encode()) % 10:
            np.add.at(counts, coded[doc_id], 1)
    inner = np.zeros(attention_lm.SYMBOLS)
    for kind in (attention_net.RARE, attention_net.RARE_INSIDE):
        mine = slots == kind
        inner[mine] = np.log10((counts[mine] + attention_lm.INNER) / (counts[mine] + attention_lm.INNER).sum())
    short = [d for d in sorted(coded) if len(coded[d]) < 400][:25]
    assert any(len(coded[d]) > attention_net.SCORED for d in short)
    for d in short:
        assert out[d] == pytest.approx(plain_score(w, coded[d], slots, inner), rel=2e-4, abs=1e-3)


def test_lm_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = attention_lm.text_scores(docs, LM_FILE).toPandas()
    held = out[out.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.05
    assert ((held.score - held.base_score) / held.n_tokens).mean() > 0.02


def test_lm_keeps_null_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 2)
    rows = [(None, "one two three"), (None, None), ("a", "one two"), ("b", "one"), ("b", "one")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3, "text")
    out = attention_lm.text_scores(docs, LM_FILE)
    assert dict(out.dtypes)["doc_id"] == "string"
    assert sorted((r.doc_id or "-", r.n_tokens) for r in out.collect()) == [("-", 1), ("-", 4), ("a", 3), ("b", 2), ("b", 2)]


def test_lm_scores_alike_however_the_table_is_split(documents, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 2)
    out = [attention_lm.text_scores(d, LM_FILE).toPandas().sort_values("doc_id") for d in (documents.coalesce(1), documents.repartition(7, "text"))]
    assert (out[0].doc_id.to_numpy() == out[1].doc_id.to_numpy()).all()
    assert np.allclose(out[0].score, out[1].score, rtol=1e-3)


@pytest.mark.parametrize("width", [1, 64, 65, 4100])
def test_sums_in_levels(width, spark):
    rows = [(int(b), 3, attention_lm.packed(np.array([1, b, 2 * b], np.int64))) for b in np.linspace(0, width - 1, 40).astype(int)]
    parts = spark.createDataFrame(rows, "bucket long, n long, a binary")
    total = sum(r[0] for r in rows)
    assert attention_lm._summed(parts, np.int64, width).tolist() == [40, total, 2 * total]


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    w = attention_net.views(attention_net.start_weights(rng.integers(1, 100, attention_net.SLOTS), 3.0, 2.0))
    ids = rng.integers(0, attention_net.SLOTS + 3, (3, attention_net.WINDOW))
    y = rng.integers(0, attention_net.SLOTS + 2, (3, attention_net.SCORED))
    return w, ids, y, rng


def test_attention_gradients():
    w, ids, y, rng = small_net()
    w = {k: v.astype(float) for k, v in w.items()}
    live = rng.random(y.shape) < 0.8
    g, loss = attention_net.gradients(w, ids, y, live)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        moved = {a: b.copy() for a, b in w.items()}
        moved[k][at] += 1e-5
        assert (attention_net.gradients(moved, ids, y, live)[1] - loss) / 1e-5 == pytest.approx(g[k][at], rel=1e-3)


def test_attention_probabilities_sum_to_one_and_look_back_only():
    w, ids, y, _ = small_net(1)
    s = attention_net.tables(w)
    every = np.arange(attention_net.SLOTS + 2)
    for place in (0, attention_net.SCORED - 1):
        total = 0.0
        for target in every:
            y[:, place] = target
            total += 10 ** float(attention_net.log10_probabilities(s, ids[:1], y[:1])[0, place])
        assert total == pytest.approx(1, abs=1e-3)
    before = attention_net.log10_probabilities(s, ids, y)
    later = ids.copy()
    later[:, attention_net.CONTEXT + 6 :] = 0
    assert np.allclose(before[:, :6], attention_net.log10_probabilities(s, later, y)[:, :6])


def test_windows_score_every_id_once():
    sizes = [1, 5, attention_net.SCORED, 3 * attention_net.SCORED + 7]
    ids = np.arange(sum(sizes))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    x, y, live, owner = attention_net.windows(ids, offsets, 10**6)
    assert sorted(y[live].tolist()) == ids.tolist()
    for row, targets, ok, doc in zip(x, y, live, owner):
        first = targets[0]
        for k, got in enumerate(row):
            want = first - attention_net.CONTEXT - 1 + k
            inside = offsets[doc] <= want < offsets[doc + 1]
            assert got == (want if inside else 10**6)


def test_training_helps():
    ids = np.tile(np.array([3, 7, 11, 19, 5]), 4000)
    x, y, live, _ = attention_net.windows(ids, np.array([0, len(ids)]))
    w = attention_net.start_weights(np.ones(attention_net.SLOTS), 1.0, 1.0)
    trained, loss = attention_net.train(w, x, y, live, 150, 16, 0.02, 0)
    assert loss < 1.5 < attention_net.gradients(attention_net.views(w), x[:50], y[:50], live[:50])[1]


def test_cnn_covers_every_byte():
    for n in (0, 1, 63, 64, 256, 257, 448, 449, 5000):
        data = (np.arange(n) % 250 + 1).astype(np.uint8)
        chunks, counts = byte_cnn.chunked(data, np.array([0, n]))
        seen = np.zeros(n, bool)
        for i in range(counts[0]):
            part = chunks[i][chunks[i] > 0]
            assert (part == data[i * byte_cnn.STRIDE :][: len(part)]).all()
            seen[i * byte_cnn.STRIDE : i * byte_cnn.STRIDE + len(part)] = True
        assert seen.all()


def test_cnn_learns_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = byte_cnn.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    for r in out.head(50).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = out[out.held_out]
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()


def plain_cnn(net, raw):
    """A text's score, chunk by chunk and place by place, in double precision."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    begins = range(0, max(1, len(raw) - (byte_cnn.CHUNK - byte_cnn.STRIDE)), byte_cnn.STRIDE)
    pooled = []
    for b in begins:
        chunk = raw[b : b + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
        places = range(0, byte_cnn.CHUNK - byte_cnn.FILTER + 1, byte_cnn.HOP)
        best = np.max([np.concatenate([w["bytes"][c] for c in chunk[p : p + byte_cnn.FILTER]]) @ w["filters"] for p in places], axis=0)
        pooled.append(np.maximum(best + w["filter_bias"], 0))
    both = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])
    z = np.maximum(both @ w["dense"] + w["dense_bias"], 0) @ w["out"] + w["out_bias"]
    return 1 / (1 + math.exp(-(z[0] + net.shift)))


def test_cnn_scores_equal_plain_scores(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept, train = [], byte_cnn.train
    monkeypatch.setattr(byte_cnn, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    out = byte_cnn.quality_scores(docs, labels).toPandas().set_index("doc_id").score
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    for doc_id, text in list(texts.items())[:60]:
        assert out[doc_id] == pytest.approx(plain_cnn(kept[0], (text or "").encode()), abs=1e-4)


def test_cnn_of_a_text_of_many_megabytes():
    net = byte_cnn.ByteNet(3)
    raw = np.random.default_rng(1).integers(1, 255, 12_000_001).astype(np.uint8)
    whole = net.score(raw, np.array([0, len(raw)]))[0]
    marked = raw.copy()
    marked[-40:] = np.frombuffer(b"the very end of the text decides as well", np.uint8)
    assert 0 <= whole <= 1 and net.score(marked, np.array([0, len(raw)]))[0] != whole


def test_cnn_sample_is_full_and_does_not_depend_on_order(spark, monkeypatch):
    rows = [(i, ("good text " if i % 2 else "bad stuff ") * (1 if i % 5 else 5000)) for i in range(200)]
    rows += [(7, "another text of the same id"), (None, "text without an id"), (None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0), (9, 1)], "doc_id long, quality int")
    met = []
    monkeypatch.setattr(byte_cnn.ByteNet, "fit", lambda self, texts, y: met.append((texts, y.tolist())))
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "text")
        assert byte_cnn.quality_scores(docs, labels.repartition(n), 20, 1000).count() == len(rows)
    assert met[0] == met[1]
    assert sum(met[0][1]) == 20 and len(met[0][1]) == 40 and max(map(len, met[0][0])) <= 1000


def test_cnn_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = byte_cnn.quality_scores(odd, labels).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    none = labels.limit(0)
    assert byte_cnn.quality_scores(odd, none).toPandas().score.round(6).eq(0.5).all()
    assert byte_cnn.quality_scores(nothing, labels).count() == 0


def test_cnn_gradient():
    net = byte_cnn.ByteNet(1)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (40, 300, 700)]
    y = np.array([1.0, 0.0, 1.0])
    g, loss = net.gradients(texts, y)
    for k in ("out", "dense", "filters", "bytes"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.w[k][at] += 1e-5
        assert (net.gradients(texts, y)[1] - loss) / 1e-5 == pytest.approx(g[k][at], rel=0.05)
        net.w[k][at] -= 1e-5


def test_pipeline_stages(spark, sf, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns, name
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()


def test_lm_tells_frequent_symbols_from_few_others():
    """A symbol's class and its neighbours there are at most 80 alternatives on average (98 with classes of one size)."""
    counts = 1e6 / np.arange(1, 4001) ** 1.1
    opens = np.arange(4000) % 3 > 0
    seats = attention_net.seats(counts, opens)
    assert len(seats) == len(set(seats)) == len(attention_net.TAKEN) == 2048
    groups = np.split(seats, np.cumsum(attention_net.SIZES)[:-1])
    assert all(opens[g].all() or not opens[g].any() for g in groups)
    assert attention_net.CLASSES + 2 + sum(counts[g].sum() * len(g) for g in groups) / counts[seats].sum() < 80
    few = attention_net.seats(np.ones(2100), np.arange(2100) < 30)
    assert len(set(few)) == 2048 and (few < 30).sum() == 30


def test_empty_slots_have_no_probability_and_stay_empty():
    counts = np.full(attention_net.SLOTS, -1)
    counts[attention_net.TAKEN] = 3
    flat = attention_net.start_weights(counts, 3.0, 2.0)
    rng = np.random.default_rng(0)
    some = np.append(attention_net.TAKEN, [attention_net.RARE, attention_net.RARE_INSIDE])
    ids, y = rng.choice(some, (40, attention_net.WINDOW)), rng.choice(some, (40, attention_net.SCORED))
    flat, _ = attention_net.train(flat, ids, y, np.ones(y.shape, bool), 5, 20, 0.02, 0)
    w = attention_net.views(flat)
    empty = np.setdiff1d(np.arange(attention_net.SLOTS), attention_net.TAKEN)
    assert (w["member_bias"].ravel()[empty] == attention_net.EMPTY).all()
    total, t, one = 0.0, attention_net.tables(w), y[:1].copy()
    for target in some:
        one[:, 0] = target
        total += 10 ** float(attention_net.log10_probabilities(t, ids[:1], one)[0, 0])
    assert total == pytest.approx(1, abs=1e-3)
