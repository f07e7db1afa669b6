"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can't be merged, whatever the merge order: a text may be cut there,
the fragments encoded by themselves and their ids concatenated. White space, and most changes between letters, digits and
punctuation, are such cuts, and the pre-tokenizer's own cuts are taken with them; the pieces between are cut further at every
other such pair, and each distinct piece is encoded once by the tokenizers library and remembered.

Null and empty texts have no ids and decode to the empty text. Texts of any length are whole: a text is only ever cut at
forced boundaries. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import slices
from lectern.plans.shared import spread

#: Pieces and bytes of one generation of a worker's memory, which holds two, and bytes of the longest piece that is remembered: bounds of memory, not of results.
MAX_PIECES, MEMO_BYTES, PIECE_BYTES = 250_000, 56 << 20, 64
#: What a piece and its ids take besides their own bytes.
_ENTRY = 200

#: Letters, digits and spaces of Latin-1 after lower-casing; in this range normalization changes nothing but case and spaces.
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Piece -> ids (bytes, little-endian unsigned 32 bits); pieces not used for a generation are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old, self.size = encode, {}, 0

    def __missing__(self, piece):
        if len(piece) > PIECE_BYTES:
            return array("I", self.encode(piece)).tobytes()
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece)).tobytes()
        self.size += len(piece) + len(ids) + _ENTRY
        if self.size > MEMO_BYTES or len(self) >= MAX_PIECES:
            self.old, self.size = dict(self), 0
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Every distinct piece goes to the tokenizers library as it is.

    Pieces are pre-tokens of the lower-cased text where all its characters are Latin-1 and words between ASCII spaces
    elsewhere; neither is changed by its surroundings in normalization, pre-tokenization or merging.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [x["content"] for x in self.spec["added_tokens"]]
        self.marks = {x[:2].encode() for x in self.special}
        self.pieces, self.words = _Memo(self.piece), _Memo(lambda word: self.word(word.decode("utf-8", "replace")))

    def piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():  # the byte-level alphabet leaves these as they are
            return self.fragments(piece)
        return self.word(piece)

    def fragments(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def word(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __call__(self, text: bytes) -> bytes:
        if not any(x in text for x in self.marks):
            if text.isascii():
                return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.decode("ascii").lower())))
            latin = text.decode("utf-8", "replace")
            try:
                latin.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.pieces.__getitem__, _PIECE.findall(latin.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))


class ForcedBoundaryEncoder(PieceEncoder):
    """Pieces are cut further wherever the vocabulary has no token across two bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        model = self.spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        #: In the byte-level alphabet one character is one byte, so pairs of characters are pairs of bytes.
        self.joined = {t[i : i + 2] for x in model["vocab"] for t in [x.removesuffix(suffix)] for i in range(len(t) - 1)}
        bare = self.spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.last = Tokenizer.from_str(json.dumps(bare)).model
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": model | {"end_of_word_suffix": None}})).model
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]

    def cut(self, piece: str) -> list[str]:
        """The fragments of one pre-token, in the byte-level alphabet."""
        at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.joined]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def fragments(self, piece: str) -> list[int]:
        *inner, last = self.cut(piece)
        return [t.id for x in inner for t in self.inner.tokenize(x)] + [t.id for t in self.last.tokenize(last)]

    def word(self, word: str) -> list[int]:
        if any(x in word for x in self.special):
            return super().word(word)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
        return [i for piece, _ in pieces for i in self.fragments(piece)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of what the library's decode gives: this vocabulary has no decoder, tokens are joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    encoder = PieceEncoder(path)
    del encoder.spec  # serves to set up only
    return encoder


@lru_cache(maxsize=2)
def forced_boundary_encoder(path: str) -> ForcedBoundaryEncoder:
    encoder = ForcedBoundaryEncoder(path)
    del encoder.spec
    return encoder


def _encoded(path: str, digest: bool):
    def run(batches):
        import pyarrow as pa

        encode = forced_boundary_encoder(path)
        for batch in slices(batches):
            n, ids_out, text_out = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text)
                n.append(len(ids) // 4)
                if digest:
                    ids_out.append(hashlib.sha256(ids).hexdigest())
                    text_out.append(hashlib.sha256(encode.decode(ids)).hexdigest())
                else:
                    ids_out.append(np.frombuffer(ids, dtype="<i4"))
                    text_out.append(encode.decode(ids).decode("utf-8", "replace"))
            kind = pa.string() if digest else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_out, kind), pa.array(text_out, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"]
            )

    return run


def _input(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")))


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (string) of every row of ``docs`` (doc_id, text)."""
    return _input(docs).mapInArrow(_encoded(tokenizer or default_tokenizer(), False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text, so that neither leaves the worker."""
    return (
        _input(docs)
        .mapInArrow(_encoded(tokenizer or default_tokenizer(), True), "doc_id long, n_tokens long, ids string, decoded string")
        .withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
    )
