"""SentencePiece models on the tokenizers library (operator 3).

:func:`parse_model` reads the model's protobuf; :func:`build_tokenizer` rebuilds
its normaliser (character map, extra white space, leading marker), the
white-space marker ``▁``, the scores (unigram) or the merges that the scores
imply (BPE) and the byte fallback.  :func:`encode` encodes and decodes batches
and compares every document's ids with those of the sentencepiece library, which
encodes whole texts with several threads.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import small_batches

MARK = "▁"
#: Kinds of pieces and of models in the public protobuf schema.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, Any]]:
    """Field numbers and values of a protobuf message: integers, floats or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        elif tag & 7 == 5:
            (value,), at = struct.unpack_from("<f", raw, at), at + 4
        elif tag & 7 == 1:
            (value,), at = struct.unpack_from("<d", raw, at), at + 8
        else:
            raise ValueError("not a protobuf message")
        yield tag >> 3, value


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap = norm.get(2, b"")
            model.dummy_prefix, model.strip_extra, model.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: each way to make a piece of two, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            ways = [(ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            found += [(-score, *way) for way in sorted(ways)]
    found.sort(key=lambda x: x[0])  # stable: the ways of one piece stay together
    return [(model.pieces[a][0], model.pieces[b][0]) for _, a, b in found]


def build_tokenizer(model: Model) -> Any:
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([p[:2] for p in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p[0]: i for i, p in enumerate(model.pieces)}, merges_of(model),
            unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are rebuilt")
    tokenizer = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if one_marker(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


def one_marker(model: Model) -> bool:
    """Whether no piece has a marker after another character: then words can be split before their markers."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


class _Words(dict):
    """Ids of words, asked for when first met."""

    def __init__(self, ids_of: Callable[[str], bytes]) -> None:
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.ids_of(word)
        return found


class Encoder:
    """Batches of texts to ids and back.

    Where words split before their markers (:func:`one_marker`), a text's ids
    are those of its words one after the other, so each distinct word goes to
    the model once.  Ids are kept as little-endian 32-bit numbers in bytes:
    lists of Python numbers take five times the memory.
    """

    #: Words after which memory starts anew, with those before at hand until the next time; an executor has a worker for each core.
    WORDS = 100_000

    def __init__(self, raw: bytes) -> None:
        import re

        self.model = parse_model(raw)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if one_marker(self.model) else None
        self.plain = not self.model.charsmap and not self.model.strip_extra and self.model.escape and self.model.dummy_prefix
        self.tokenizer = build_tokenizer(self.model)
        self.normalizer = self.tokenizer.normalizer
        self.core = self.tokenizer.model
        self.ids = _Words(self._ids)
        self.older: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.split is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.ids) > self.WORDS:
            self.older, self.ids = self.ids, _Words(self._ids)
        return [b"".join(map(self.ids.__getitem__, self._words(t))) for t in texts]

    def _words(self, text: str) -> list[str]:
        """The words of a text once it is normal; of a plain model's, which all begin with a marker, what follows that."""
        if not self.plain:
            return self.split.findall(self.normalizer.normalize_str(text))
        if not text:
            return []
        if "  " not in text and text[0] != " " and MARK not in text:  # each blank begins a word
            return text.split(" ")
        return [w[1:] for w in self.split.findall(MARK + text.replace(" ", MARK))]

    def _ids(self, word: str) -> bytes:
        known = self.older.get(word)
        return known if known is not None else array("I", [t.id for t in self.core.tokenize(MARK + word if self.plain else word)]).tobytes()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [memoryview(x).cast("I").tolist() for x in self.pack(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder_of(model_path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    with open(model_path, "rb") as f:
        return Encoder(f.read())


def encode(docs: DataFrame, model_path: str, threads: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded, parity`` and ``ids`` of every text.

    ``decoded`` is the text that the ids give back, ``parity`` whether the
    sentencepiece library gives the same ids.  Null texts count as empty (no
    ids); texts of any length are encoded whole; an empty table gives no rows.  Rows that repeat stay rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded string, parity boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece

        encoder = encoder_of(model_path)
        peer = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.iloc[a : a + 200]
                texts = list(part["text"])
                packed = encoder.pack(texts)
                theirs = peer.encode_as_numpy(texts, num_threads=threads)
                columns = {"ids": [np.frombuffer(x, "<i4") for x in packed]} if with_ids else {}
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc"].astype("Int64").array,
                        "n_pieces": [len(x) // 4 for x in packed],
                        "ids_crc32": [zlib.crc32(x) for x in packed],
                        "decoded": [encoder.decode(memoryview(x).cast("I")) for x in packed],
                        "parity": [x == y.astype("<u4").tobytes() for x, y in zip(packed, theirs, strict=True)],
                    }
                    | columns
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)
