import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import merkle_manifest, piece_codec
from tallyglass.llm.queries import tokenizer_file

KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(top, for each node its siblings level by level as (left, right))."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, merged = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for i in range(len(run)):
                for g in groups[a + i]:
                    paths[g].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            merged.append([g for x in groups[a : a + 16] for g in x])
        nodes, groups = up, merged
    return nodes[0], paths


def manifest_brute(rows):
    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, r["text"].translate(lower) if bad else r["text"]), r["doc_id"]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb([x[2] for x in sorted(by[s])]) for s in sources]
    root, above = climb([t[0] for t in tops])
    out = []
    for s, (sub, paths), more in zip(sources, tops, above, strict=True):
        for (_, _, own, bad, doc), path in zip(sorted(by[s]), paths, strict=True):
            at = bad
            for left, right in path + more:
                at = h(left, at, right)
            out.append((doc, own, sub, root, h(*[x + y for x, y in path + more]), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("which,part", [("documents", 37), ("odd", 50_000), ("nothing", 50_000)])
def test_manifest_equals_brute_force(which, part, request, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PART_ROWS", part)
    docs = request.getfixturevalue(which)
    rows = [r.asDict() for r in docs.collect()]
    got = sorted((tuple(r) for r in merkle_manifest.proof_report(docs).collect()), key=str)
    assert got == (manifest_brute(rows) if rows else [])


def test_manifest_of_deep_shallow_and_odd_sources(spark):
    """One source of three levels, one row alone, null source and ids, equal rows, clashing names."""
    rows = [(i, "big", "en", i, f"Text {i}", "x", "y") for i in range(5000)]
    rows += [(7, None, None, None, None, None, None), (None, "big", "en", 1, "Null id", "x", "y"), (None, "ü", "en", 1, "Ä", "x", "y")]
    rows += [(3, "small", "en", 1, "AB", "x", "y")] * 40 + [(5, "one", "en", 2, "cd", "x", "y")]
    docs = spark.createDataFrame(rows, KINDS)
    got = sorted((tuple(r) for r in merkle_manifest.proof_report(docs).collect()), key=str)
    assert got == manifest_brute([r.asDict() for r in docs.collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_many_sources_and_of_one(spark):
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    for docs in (many, many.withColumn("source", F.lit("a")), many.limit(1)):
        got = sorted((tuple(r) for r in merkle_manifest.proof_report(docs).collect()), key=str)
        assert got == manifest_brute([r.asDict() for r in docs.collect()])


def test_descent_of_some_requests_only(spark):
    """Requests may be any rows; the others' branches are left on the way."""
    nodes = spark.range(3000).select(F.lit("k").alias("tg_key"), F.col("id").alias("tg_rank"), F.lit(3000).cast("long").alias("tg_n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    records, tops = merkle_manifest.grow(nodes)
    tops = tops.withColumn("tg_path", F.array().cast("array<struct<left:string,right:string>>"))
    asked = spark.createDataFrame([("k", 0), ("k", 17), ("k", 2999)], "tg_key string, tg_rank long")
    found = merkle_manifest.descend(records, tops, asked, []).select("tg_rank", "digest", merkle_manifest.folded(F.col("digest"), F.reverse("tg_path")).alias("top")).collect()
    assert {r.tg_rank: r.digest for r in found} == {i: h(str(i)) for i in (0, 17, 2999)}
    assert {r.top for r in found} == {tops.first().digest}


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def pieces_brute(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "")
        out.append((doc, len(ids), h(",".join(map(str, ids))), h(library.decode(ids))))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_pieces_equal_the_library(which, request, library):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in piece_codec.codec_report(docs, tokenizer_file("piece_bpe_32k.model")).collect()), key=str)
    assert got == pieces_brute(library, rows)


ODD = ["", " ", "a", " a", "a  b\n\nc", "▁a", "x▁ y", "x ▁ ▁y", "<s>", "<0x0A>", "\xa0a　b", "ﬁ½", "é", "\x00a", "a퟿𝔘" * 50, "日本語の文章" * 30, "\n" * 100, " " * 100, "a" * 3000, "aab" * 999, "\t\t x", "▁▁▁", "don't   stop", "𝔘 𝔘", "ab" * 20_000]


def odd_texts():
    import random

    draw = random.Random(1)
    letters = list("aabetin  \n.,▁é日𝔘")
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 200))) for _ in range(2000)]


@pytest.mark.parametrize("lot,short", [(500_000, 48), (7, 3), (1000, 0)])
def test_odd_texts_and_small_lots(lot, short, monkeypatch, library):
    import numpy as np

    monkeypatch.setattr(piece_codec, "LOT", lot)
    monkeypatch.setattr(piece_codec, "SHORT", short)
    own = piece_codec.PieceCodec(tokenizer_file("piece_bpe_32k.model"))
    texts = odd_texts()
    assert [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)] == library.encode(texts)


def test_a_difference_from_the_library_is_an_error():
    own = piece_codec.PieceCodec(tokenizer_file("piece_bpe_32k.model"))
    own.pair_ranks = own.pair_ranks[::-1].copy()
    with pytest.raises(ValueError, match="otherwise"):
        own.encode(["the library encodes this text by merges in another order"])


def test_pieces_keep_null_and_string_ids(spark, library):
    docs = spark.createDataFrame([(None, "x y", 1), (None, None, 2), ("9" * 30, "the text", 3)], "doc_id string, text string, ids int")
    got = sorted((tuple(r) for r in piece_codec.codec_report(docs, tokenizer_file("piece_bpe_32k.model")).collect()), key=str)
    assert got == pieces_brute(library, [(r.doc_id, r.text) for r in docs.collect()])
    out = piece_codec.encode_texts(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert {(r.doc_id, r.decoded) for r in out} == {(None, "x y"), (None, ""), ("9" * 30, "the text")}
