"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of ``doc_id`` and sorted, so files and stripes follow each other in ascending order and their
metadata prune look-ups. Null ids come first. Null and empty texts have the end id alone; rows with the same id keep the
order of their texts. An empty table gives an empty set of files. Bytes that are no UTF-8 are encoded as U+FFFD.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import Rows, as_text, id_text, partitions, picked, record, shared_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
}
#: Remembered words in one worker, and the longest of them.
MEMO_WORDS = 900_000
MEMO_LENGTH = 48
# Words of these characters are already in normal form; their lower case is one character each.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+")


class WordCodec:
    """Ids as little-endian 32-bit integers, word by word.

    The pre-tokenizer never joins across white space, so the ids of a text are those of its words in turn; words are
    encoded by the tokenizers library once and remembered, up to a bound. A to Z are lowered first, as its normaliser does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, many to a call: the last id of each ends a word."""
        lines = [" ".join(parts[k : k + 256]) for k in range(0, len(parts), 256)]
        if not lines:
            return []
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in found])
        cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(cuts) != len(parts):
            return self._library(parts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not remembered."""
        alone, split, whole = {}, {}, []
        # No word holds a line break, so all are decoded at once.
        for word, text in zip(words, as_text(b"\n".join(words)).split("\n")):
            if not _PLAIN.fullmatch(text):
                whole.append(word)
            elif text.isalpha() and text.islower():
                alone[word] = text
            else:
                split[word] = _PIECE.findall(text.lower())
        every = {p for parts in split.values() for p in parts}.union(alone.values())
        new = every.difference(self.parts)
        if len(self.parts) + len(new) > MEMO_WORDS:
            self.parts, new = {}, every
        fresh = sorted(new)
        self.parts.update(zip(fresh, self._pieces(fresh)))
        get = self.parts.__getitem__
        learnt = dict(zip(alone, map(get, alone.values())))
        learnt.update((word, b"".join(map(get, parts))) for word, parts in split.items())
        learnt.update(zip(whole, self._library([as_text(w) for w in whole])))
        if len(self.parts) > MEMO_WORDS:
            self.parts = {}
        return learnt

    def _coded(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, remembered ones and others."""
        found = list(map(self.words.get, words))
        if None not in found:
            return found
        learnt = self._learn({word for word, ids in zip(words, found) if ids is None})
        if len(self.words) + len(learnt) > MEMO_WORDS:
            self.words = {}
        self.words.update(learnt)
        for word in [w for w in learnt if len(w) > MEMO_LENGTH]:
            del self.words[word]
        return [learnt[word] if ids is None else ids for word, ids in zip(words, found)]

    def encode_lists(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text begins among them; the end is the last entry.

        Arrow splits the texts and numbers their different words, so that each of these is looked up once.
        """
        raw = pa.array([t or b"" for t in texts], pa.large_binary())
        # The same bytes under the type that these two functions ask for; both go byte by byte.
        plain = pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = lists.values.dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        cuts = np.frombuffer(offsets, np.int64, len(words.dictionary) + 1).tolist() if offsets else [0]
        data = data.to_pybytes() if data else b""
        coded = self._coded([data[a:b] for a, b in zip(cuts, cuts[1:])])
        flat = np.frombuffer(b"".join(coded), dtype="<u4")
        sizes = np.array(list(map(len, coded)), dtype=np.int64) // 4
        at, codes = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        ids = flat[np.repeat(at[codes] - ends[:-1], sizes[codes]) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy()]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        ids, starts = self.encode_lists(texts)
        data, cuts = ids.tobytes(), (4 * starts).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the files. ``local_start`` counts the ids before a document in its own file."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Rows) -> Rows:
        coder, part, start = codec(path), TaskContext.get().partitionId(), 0
        for ids, texts in id_text(batches, 2 << 20):
            values, starts = coder.encode_lists(texts)
            values = np.insert(values.view("<i4"), starts[1:], end_id)
            offsets = starts + np.arange(len(starts))
            counts = np.diff(offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(counts), lists],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    spark = docs.sparkSession
    ordered = picked(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files; filters on ``doc_id`` reach stripes and row groups through their statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = read(spark, path)
    # One row per file.
    sizes = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    before = dict(zip([p for p, _ in sizes], accumulate([0, *[n for _, n in sizes]])))

    def run(batches: Rows) -> Rows:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            crcs = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            starts = [before[p] + s for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield record(
                {
                    "doc_id": (batch.column(0).to_pylist(), pa.int64()),
                    "start": (starts, pa.int64()),
                    "n_tokens": (batch.column(3).to_pylist(), pa.int64()),
                    "ids_crc32": (crcs, pa.int64()),
                }
            )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None, out: str | None = None) -> DataFrame:
    out = out or shared_dir(docs.sparkSession)
    write(docs, out, path)
    return read_digest(docs.sparkSession, out)
