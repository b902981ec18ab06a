"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Null and empty texts have no tokens and decode to no bytes. Rows are independent, so repeated rows give repeated results
and an empty table an empty one. Text of any length is encoded whole: it is cut where no match of the pattern can cross.
Bytes that are no UTF-8 are encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import Rows, as_text, id_text, map_text, record

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
# A blank after a letter or digit: the blank can only begin a match, and no match goes on into white space.
_SAFE = re.compile(r"(?<=[^\W_])[ \n]")


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """The text cut before blanks that start a match; joined they are the text again."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(coder: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in coder.encode_ordinary(piece)]


def default_ranks() -> str:
    return public_tokenizers.path(RANKS)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    path = path or default_ranks()

    def run(batches: Rows) -> Rows:
        coder = codec(path, pattern)
        for ids, texts in id_text(batches):
            tokens = [encode_text(coder, as_text(t)) for t in texts]
            yield record({"doc_id": (ids, pa.int64()), "ids": (tokens, pa.list_(pa.int32()))})

    return map_text(docs, run, "doc_id long, ids array<int>", id_col, text_col)


def decode(tokens: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, data): the bytes of every id list; a null list has none."""
    path = path or default_ranks()

    def run(batches: Rows) -> Rows:
        coder = codec(path, pattern)
        for batch in batches:
            data = [coder.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield record({"doc_id": (batch.column(0).to_pylist(), pa.int64()), "data": (data, pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ``ids`` if asked for: digests are taken where the ids are made."""
    path = path or default_ranks()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Rows) -> Rows:
        coder = codec(path, pattern)
        names = [str(i) for i in range(coder.n_vocab)]
        for ids, texts in id_text(batches):
            counts, coded, decoded, held = [], [], [], []
            for text in texts:
                tokens = encode_text(coder, as_text(text))
                counts.append(len(tokens))
                coded.append(hashlib.sha256(",".join(map(names.__getitem__, tokens)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode_bytes(tokens)).hexdigest())
                if with_ids:
                    held.append(np.array(tokens, np.int32))
            columns = {
                "doc_id": (ids, pa.int64()),
                "n_tokens": (counts, pa.int64()),
                "ids_sha256": (coded, pa.string()),
                "decoded_sha256": (decoded, pa.string()),
            }
            yield record(columns | ({"ids": (held, pa.list_(pa.int32()))} if with_ids else {}))

    return map_text(docs, run, schema, id_col, text_col)
