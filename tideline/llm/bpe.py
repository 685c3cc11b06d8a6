"""Byte-level BPE: a sentencepiece model written straight from a vocabulary of ranks, encoding and decoding.

Every byte has a printable character of its own; a token's bytes, so mapped, are a piece with minus its rank as score.
sentencepiece then merges by best score, which is lowest rank. Nothing is normalised: no prefix, no
escaped or squeezed white space. Each pre-token is encoded by itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Pre-tokens that a worker remembers; beyond it, it starts anew.
MEMORY = 200_000
_loaded: dict[int, tuple] = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank; ranks must be 0 to n - 1."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[i] for i in range(len(found))]


def byte_characters() -> list[str]:
    """A character for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def piece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last and is never produced when all bytes are tokens."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = pb.TrainerSpec.BPE, len(model.pieces), len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Encoder(dict):
    """From a pre-token to its ids as little-endian unsigned 32-bit integers, filled as pre-tokens come."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.whole = {t: i for i, t in enumerate(tokens)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.mapped = dict(enumerate(byte_characters()))

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        rank = self.whole.get(raw)
        ids = [rank] if rank is not None else self.pieces.encode(raw.decode("latin-1").translate(self.mapped))
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def text_of(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(shipped, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    at = id(shipped.value)
    if at not in _loaded:
        _loaded.clear()
        tokens, model = shipped.value
        _loaded[at] = (Encoder(tokens, model, pattern), shipped.value)
    return _loaded[at][0]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary, little-endian unsigned 32-bit) of every whole text.

    A null text is an empty one: no tokens, no bytes. Strings of special tokens are ordinary text. Rows stand for themselves, so
    repeated rows give repeated rows. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, piece_model(tokens)))  # about 2 MB for 50,000 tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shipped, pattern)
        for batch in batches:
            ids = [coder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [key, "n_tokens", "ids"])

    frame = small_batches(docs.select(F.col(key), F.col(text)))
    return frame.mapInArrow(tidy(run), f"`{key}` {frame.schema[0].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokens: list[bytes], ids: str = "ids") -> DataFrame:
    """encoded, with a binary column decoded: the bytes of the ids by the inverse mapping. Null ids decode to no bytes.

    Ids that are no rank raise IndexError.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(tokens)  # under a MB for 50,000 tokens
    schema = encoded.schema
    at = schema.fieldNames().index(ids)
    if "decoded" in schema.fieldNames():
        raise ValueError("there is a column decoded already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            out = [text_of(x, known) if x else b"" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return small_batches(encoded).mapInArrow(tidy(run), T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType())]))
