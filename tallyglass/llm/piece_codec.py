"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by an agenda of adjacent pairs.

A text is normalised by the library, then split into chunks that no merge can cross: before a run of space
marks, and around characters that occur in no piece of several characters (both read from the vocabulary).
In a chunk every character starts as a symbol; its agenda holds each adjacent pair whose joined text is a
piece, by score, the leftmost first among equals. The first pair is merged, pairs that named one of its
symbols lapse, and the pairs with its new neighbours join the agenda, until none is left. What is no piece
then becomes its UTF-8 bytes. Short chunks take their steps together, one merge in every chunk a round, as
numpy arrays; a chunk of over `SHORT` characters is cut where its characters are neighbours in no piece and
has a heap of its own. Chunks come again and again, so a worker remembers the ids of `CACHE_CHUNKS` short ones.

Before a lot of an Arrow batch's chunks is used, those not met before are encoded by the library too, in one
call, and a difference is an error, never a silent result. Decoding is the library's.

Models of another type, with pieces defined by the user or without byte fallback are refused.

Defined results: null or empty text has no ids and decodes to an empty text; a space mark in a text counts
as a space; names of control pieces in a text are ordinary text; repeated rows are encoded each; a null doc_id
stays null; an empty table gives no rows; other columns are ignored. A very long text is worked on in slices
of `LOT` characters; its ids and decoded text are held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import blocks

MARK = "▁"
CACHE_CHUNKS = 1_000_000
SHORT = 48
LOT = 500_000
BLOCK_BYTES = 4 << 20
NEVER = np.int32(2**31 - 1)


class PieceCodec:
    """Ids of texts by a SentencePiece model file, and back."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.ids = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        several = [p for p in self.ids if len(p) > 1]
        if not all(map(lib.is_byte, self.byte_ids.tolist())):
            raise ValueError("the model has no byte fallback")
        if any(lib.get_score(self.ids[p]) > 0 or lib.get_score(self.ids[p]) != int(lib.get_score(self.ids[p])) for p in several):
            raise ValueError("the model's scores are no merge order")
        #: Merge order: the place of a piece's score among all, equal for equal scores.
        scores = sorted({lib.get_score(self.ids[p]) for p in several}, reverse=True)
        place = {v: i for i, v in enumerate(scores)}
        self.ranks = {p: place[lib.get_score(self.ids[p])] for p in several}
        self.neighbours = {p[i : i + 2] for p in several for i in range(len(p) - 1)}
        inner = {c for p in several for c in p}
        if any(a != MARK and b == MARK for a, b in self.neighbours) or "\n" in inner:
            raise ValueError("the model's pieces reach over spaces or lines")
        kind = "".join(map(re.escape, sorted(inner - {MARK})))
        self.split = re.compile(f"{MARK}+[{kind}]*|[{kind}]+|[^{kind}{MARK}]+")
        self.gap = re.compile(f"(?<=[^{MARK}]){MARK}")
        self._tables(inner, several, n)
        self.cache: dict[str, bytes] = {}
        self.first = lib.encode("\n")

    def _tables(self, inner: set[str], several: list[str], n: int) -> None:
        """Symbols as numbers: a piece's is its id, other characters inside pieces follow, all else is `none`."""
        symbols = dict(self.ids)
        for c in sorted(inner):
            symbols.setdefault(c, n + len(symbols))
        self.none = max(symbols.values()) + 1
        self.limit = n
        self.of_char = np.full(0x110000, self.none, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        pairs = [(symbols[p[:i]] * (self.none + 1) + symbols[p[i:]], self.ranks[p], symbols[p]) for p in several for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        keys, ranks, joined = (np.array(x) for x in zip(*sorted(pairs), strict=True))
        self.keys, self.pair_ranks, self.joined = keys.astype(np.int64), ranks.astype(np.int32), joined.astype(np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (`NEVER`: no piece) and the symbol it becomes."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.pair_ranks[at], NEVER), self.joined[at]

    def short_agendas(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks, one merge in every chunk a round."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        symbols, place = self.of_char[points], np.arange(len(points))
        rank, becomes = np.full(len(points), NEVER), np.zeros(len(points), np.int32)  # of a symbol and its right neighbour
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same], becomes[same] = self.look_up(symbols[same], symbols[same + 1])
        done = []
        while len(owner):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = best < NEVER
            if not live.all():
                done.append((owner[~live], symbols[~live], place[~live]))
                owner, symbols, place, rank, becomes, best = (x[live] for x in (owner, symbols, place, rank, becomes, best))
            at = np.flatnonzero(rank == best)
            if not len(at):
                continue
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))]
            symbols[at] = becomes[at]
            stay = np.ones(len(owner), bool)
            stay[at + 1] = False
            owner, symbols, place, rank, becomes = (x[stay] for x in (owner, symbols, place, rank, becomes))
            at -= np.arange(len(at))  # one symbol went for every merge before
            for i in (at, at[at > 0] - 1):
                rank[i] = NEVER
                i = i[i + 1 < len(owner)]
                i = i[owner[i] == owner[i + 1]]
                rank[i], becomes[i] = self.look_up(symbols[i], symbols[i + 1])
        owner, symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        owner, symbols, place = owner[order], symbols[order], place[order]
        lost = np.flatnonzero(symbols >= self.limit)
        raw = [chr(c).encode() for c in points[place[lost]].tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[lost] = list(map(len, raw))
        ids = np.repeat(symbols, counts)
        ids[ids >= self.limit] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(np.bincount(owner, counts, len(chunks)).astype(np.int64)) * 4
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk, its pairs in a heap."""
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(ranks[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in ranks]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left = symbols[i]
            j = after[i]
            if left is None or j == n or len(left) + len(symbols[j]) != len(pair):
                continue  # one of its symbols was merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in ranks:
                    heappush(agenda, (ranks[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in ranks:
                heappush(agenda, (ranks[new], h, new))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                at = self.ids.get(s)
                out += [at] if at is not None else self.byte_ids[list(s.encode())].tolist()
        return out

    def long_agenda(self, chunk: str) -> bytes:
        pairs = self.neighbours
        cuts = [0, *[i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in pairs], len(chunk)]
        ids = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in self.agenda(chunk[a:b])]
        return np.array(ids, "<i4").tobytes()

    def check(self, chunks: list[str], ids: list[bytes]) -> None:
        """Hold chunks against the library; a line feed before each keeps them off the space mark it puts first."""
        texts = ["\n" + c.replace(MARK, " ") for c in chunks]
        for c, own, theirs in zip(chunks, ids, self.library.encode(texts, num_threads=1), strict=True):
            if np.array(theirs[len(self.first) :], "<i4").tobytes() != own:
                raise ValueError(f"the library encodes {c[:200]!r} otherwise than the agenda")

    def slices(self, text: str) -> Iterator[str]:
        """The normalised text in slices of about `LOT` characters, cut between chunks."""
        text = self.library.normalize(text) if text else ""
        at = 0
        while at < len(text):
            cut = self.gap.search(text, at + LOT)
            to = cut.start() if cut else len(text)
            yield text[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        lot, size = [], 0
        for i, text in enumerate(texts):
            for part in self.slices(text):
                lot.append((i, self.split.findall(part)))
                size += len(part)
                if size >= LOT:
                    self._encode_lot(lot, out)
                    lot, size = [], 0
        self._encode_lot(lot, out)
        return [b"".join(x) for x in out]

    def _encode_lot(self, lot: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        known = self.cache
        found = [list(map(known.get, chunks)) for _, chunks in lot]
        new = sorted({c for (_, chunks), got in zip(lot, found, strict=True) if None in got for c, ids in zip(chunks, got, strict=True) if ids is None})
        if new:
            short, long = [c for c in new if len(c) <= SHORT], [c for c in new if len(c) > SHORT]
            ids = (self.short_agendas(short) if short else []) + list(map(self.long_agenda, long))
            self.check(short + long, ids)
            learned = dict(zip(short + long, ids, strict=True))
            known.update(zip(short, ids, strict=False))
            found = [[learned[c] if ids is None else ids for c, ids in zip(chunks, got, strict=True)] if None in got else got for (_, chunks), got in zip(lot, found, strict=True)]
        for (i, _), got in zip(lot, found, strict=True):
            out[i].append(b"".join(got))


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model in a Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) for every row."""
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model)
        for batch in batches:
            for block in blocks(batch.column("tg_text"), BLOCK_BYTES):
                raw = block.data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
                ids = pieces.encode(texts)
                decoded = pa.array([pieces.library.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string())
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                columns = [batch.column("doc_id").slice(block.first, block.n), pa.ListArray.from_arrays(pa.array(offsets), flat), decoded]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("tg_text")).mapInArrow(run, schema)


def codec_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode_texts(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
