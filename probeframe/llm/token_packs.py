"""Token ids in fixed-width bit packs (operator 1).

A *pack* holds whole documents.  Its layout, all little-endian::

    header        magic "PFTK", version u8, bits u8, block length u16,
                  documents u32, tokens u64
    document ids  documents x i64, then documents x u8 (0: the id is null)
    lengths       documents x u64 (tokens of each document)
    blocks        (blocks + 1) x u64, byte offsets into the payload
    payload       blocks of `block length` ids; each id takes `bits` bits,
                  the fewest that hold every id of the vocabulary

Each block starts on a byte, so any token range unpacks from the blocks that
cover it (:func:`read_range`) by vectorised numpy.  Packs are rows of a Parquet
table, which any store that Spark reaches can hold; ``shard`` and ``pack`` give
their order and ``shard_start`` the tokens before the pack in its shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import broadcast_if_small, materialize, small_batches

HEADER = struct.Struct("<4sBBHIQ")
MAGIC = b"PFTK"
#: Ids in a block, tokens after which a pack is closed.
BLOCK, PACK_TOKENS = 4096, 1 << 18
PACK_SCHEMA = "shard int, pack int, shard_start long, n_tokens long, n_docs int, payload binary"


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def build_pack(doc_ids: list, docs: list[np.ndarray], bits: int) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join(
        [
            HEADER.pack(MAGIC, 1, bits, BLOCK, len(docs), len(ids)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.array([len(d) for d in docs], "<u8").tobytes(),
            offsets.tobytes(),
            *blocks,
        ]
    )


class Pack:
    """Reads a pack; only the blocks that are asked for are unpacked."""

    def __init__(self, raw: bytes) -> None:
        magic, version, self.bits, self.block, self.n_docs, self.n_tokens = HEADER.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token pack")
        at, n = HEADER.size, self.n_docs
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.lengths = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = memoryview(raw)[at + 17 * n + 8 * (blocks + 1) :]

    def read_range(self, start: int, stop: int) -> np.ndarray:
        """Ids of the tokens ``start`` to ``stop`` of this pack."""
        first, last = start // self.block, -(-stop // self.block)
        parts = [
            unpack_bits(self.payload[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_tokens - k * self.block), self.bits)
            for k in range(first, last)
        ]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids[start - first * self.block : stop - first * self.block]


class WordMemo:
    """Encodes texts with a tokenizers file, and each distinct word only once.

    A pre-tokenizer that keeps the matches of one pattern (`Split`, inverted,
    the rest removed) makes a text's ids the ids of its words, one after the
    other.  Where the file has that form, and a text only Latin letters, digits
    and ASCII marks (for which Python's lower case and patterns agree with the
    library's), the words are looked up and new ones encoded by the library in
    one batch.  Every other text goes to the library whole.  The results are
    the same; the tests compare them.
    """

    #: Characters outside of this, or a special token's opening, send a text to the library whole.
    PLAIN = r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\|"
    #: Words that a process keeps, some 200 bytes each; words that go to the library at once.
    WORDS, TOGETHER = 400_000, 500
    #: Classes of the file's pattern as Python's own, which agree on plain texts.
    CLASSES = ((r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+"), (r"[\p{L}]", r"[^\W\d_]"), (r"[\p{N}]", r"\d"))

    def __init__(self, path: str) -> None:
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.odd = re.compile(self.PLAIN)
        spec = json.load(open(path, encoding="utf-8"))
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        split = steps[0]
        fits = (
            split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
            and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and norms == ["NFC", "Replace", "Lowercase"] and spec.get("post_processor") is None
        )
        pattern = split["pattern"]["Regex"] if fits else r"\p"
        for old, new in self.CLASSES:
            pattern = pattern.replace(old, new)
        self.words = None if r"\p" in pattern else re.compile(pattern)

    def learn(self, words: list[str]) -> None:
        """Encodes words that are new, many in one text with a space between; the library tells which ids are whose."""
        for a in range(0, len(words), self.TOGETHER):
            some = words[a : a + self.TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            raw, cuts = np.array(found.ids, "<u4").tobytes(), np.flatnonzero(np.diff(np.array(found.word_ids))) + 1
            ends = [0, *(4 * cuts).tolist(), len(raw)]
            if len(ends) == len(some) + 1:
                self.ids.update(zip(some, (raw[p:q] for p, q in zip(ends, ends[1:], strict=False)), strict=True))
            else:
                for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    self.ids[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.words is None or self.odd.search(t)]
        out: list = [None] * len(texts)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        words = {i: self.words.findall(t.lower()) for i, t in enumerate(texts) if out[i] is None}
        if len(self.ids) > self.WORDS:
            self.ids.clear()
        self.learn(list({w for ws in words.values() for w in ws if w not in self.ids}))
        for i, ws in words.items():
            out[i] = np.frombuffer(b"".join(map(self.ids.__getitem__, ws)), "<u4")
        return out


@lru_cache(maxsize=1)
def memo_of(path: str) -> WordMemo:
    """One memo for all tasks of a worker process."""
    return WordMemo(path)


def write_packs(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and packs ``docs`` in ascending ``doc_id`` order; returns a scan of the written packs.

    Null ids come first, a null text is an empty one, rows that repeat an id
    stay rows; ties are in the order of the text's hash.  Other columns are not
    read.  An empty table makes an empty table of packs.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = memo_of(tokenizer)
        bits = bits_for(max(memo.tokenizer.get_vocab_size(), end_id + 1))
        shard, pack, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        kept: list[np.ndarray] = []
        held = 0

        def close() -> pd.DataFrame:
            row = [shard, pack, before, held, len(ids), build_pack(ids, kept, bits)]
            return pd.DataFrame([row], columns=[c.split()[0] for c in PACK_SCHEMA.split(", ")])

        for batch in batches:
            for a in range(0, len(batch), 100):
                part = batch.iloc[a : a + 100]
                for d, e in zip(part["doc"], memo.encode(list(part["text"])), strict=True):
                    ids.append(None if pd.isna(d) else int(d))
                    kept.append(np.append(e, np.uint32(end_id)))
                    held += len(e) + 1
                    if held >= PACK_TOKENS:
                        yield close()
                        pack, before, held = pack + 1, before + held, 0
                        ids, kept = [], []
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"))
    return materialize(ordered.mapInPandas(run, PACK_SCHEMA), "packs")


def read_packs(packs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32``, from the packs' bytes.

    ``start`` counts the ids of all documents before: the sum of the shards
    before (one row a shard, checked before it is broadcast), the pack's place
    in its shard and the document's in its pack.
    """
    sums = packs.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = materialize(sums.selectExpr("shard", "sum(tokens) over (order by shard) - tokens as base"), "bases")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, at, raw in zip(batch["base"], batch["shard_start"], batch["payload"], strict=True):
                pack = Pack(raw)
                ids, ends = pack.read_range(0, pack.n_tokens).astype("<u4"), np.cumsum(pack.lengths)
                starts = ends - pack.lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(pack.doc_ids, "Int64").copy() if pack.known.all() else pd.array(np.where(pack.known, pack.doc_ids, None), "Int64"),
                        "start": base + at + starts,
                        "n_tokens": pack.lengths,
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    rows = packs.select("shard", "shard_start", "payload").join(broadcast_if_small(before, 1_000_000), "shard")
    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
