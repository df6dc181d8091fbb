"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, so files, stripes and rows are in ascending order; a reader that asks for ids or a range of
them (see lookup) skips files, stripes and row groups by their statistics and Bloom filters, and stripes are read in parallel. A row holds its
shard (file), seq (place in it), doc_id, n_tokens and ids with the end id; and weight, how often a reader counts it, where the documents have one.

Ids are those of the library's encode(text, add_special_tokens=False), special tokens' strings included. Words come again and again, so each worker keeps
the ids of the words it has met, in arrays of at most TABLE_BYTES. Texts are cut to words only where the vocabulary's file says that words can be encoded by
themselves (no normaliser, byte-level pieces by the usual pattern, plain merges), and never if they hold an added token's string or unusual white space:
other texts and other vocabularies are encoded whole.

Defined results: null and empty texts are the end id alone. A null doc_id comes first; repeated ids follow each other in the order of their texts, one row
each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, cut, fresh_path, prefix_hashes, shuffle_partitions, small_batches, span_hashes

END = 0
TABLE_BYTES = 64 << 20  # of a worker's known words; beyond it the worker begins anew
WORD_BYTES = 48  # longer pieces aren't kept
BATCH_BYTES = 3 << 20
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20)}
WEIGHT = ", weight double"  # of docs that have one, at the end of a row
COLUMNS = "shard int, seq long, doc_id long, n_tokens int, ids array<int>"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _flags(*parts) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for p in parts:
        out[list(p)] = True
    return out


_BLANK = _flags(range(9, 14), [32])
_ALNUM = _flags(range(48, 58), range(65, 91), range(97, 123))
_DIGIT = _flags(range(48, 58))
_LETTER = _ALNUM & ~_DIGIT
_MARK = _flags(range(33, 127)) & ~_ALNUM & ~_flags(b"'")
_ACCENTED = _flags(range(0x80, 0xC0)) & ~_flags([0x97, 0xB7])  # second bytes after C3: letters but for the two signs
_ODD_LEAD = _flags(range(28, 32), [0xC2, 0xE1, 0xE2, 0xE3])
#: White space beyond ASCII, and four separators that not every matcher takes for it.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _spelling() -> np.ndarray:
    """The byte-level alphabet by its rule: bytes that print stand for themselves, the others for the characters from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}
    return np.array([rest.get(b, b) for b in range(256)], dtype="<u2")


_SPELLING = _spelling()


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Known words and their ids: flat arrays, found by hash (open addressing) and compared by bytes."""

    def __init__(self):
        self.hash, self.slots = np.zeros(0, np.uint64), np.full(1 << 16, -1, np.int32)
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.at, self.size, self.first, self.n = (np.zeros(0, np.int32) for _ in range(4))  # bytes from, how many; ids from, how many

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def find(self, h: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entries of words given by hash and bytes, or -1."""
        out, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        mask = np.uint64(len(self.slots) - 1)
        slot = h & mask
        while len(left):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.hash[entry] == h[left]) if len(self.hash) else np.zeros(len(left), bool)
            out[left[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        met = np.flatnonzero(out >= 0)
        entry = out[met]
        met, entry, wrong = met[same := self.size[entry] == size[met]], entry[same], met[~same]
        unlike = self.data[_ragged(self.at[entry], self.size[entry])] != data[_ragged(at[met], size[met])]
        if unlike.any():
            wrong = np.append(wrong, met[np.unique(np.repeat(np.arange(len(met)), size[met])[unlike])])
        out[wrong] = -1
        return out

    def add(self, h: np.ndarray, data: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New words: hashes, their bytes in a row and how many each, their ids in a row and how many each."""
        old = len(self.hash)
        self.at = np.append(self.at, (len(self.data) + np.cumsum(size) - size).astype(np.int32))
        self.first = np.append(self.first, (len(self.ids) + np.cumsum(n) - n).astype(np.int32))
        self.hash, self.data, self.ids = np.append(self.hash, h), np.append(self.data, data), np.append(self.ids, ids.astype(np.int32))
        self.size, self.n = np.append(self.size, size.astype(np.int32)), np.append(self.n, n.astype(np.int32))
        if 2 * len(self.hash) > len(self.slots):
            self.slots, old = np.full(1 << int(4 * len(self.hash) - 1).bit_length(), -1, np.int32), 0
        mask = np.uint64(len(self.slots) - 1)
        left = np.arange(old, len(self.hash), dtype=np.int32)
        slot = self.hash[left] & mask
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several for a slot one stays
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask


class Encoder:
    """Texts to ids, as the library's encode gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        pieces, model = spec["pre_tokenizer"] or {}, spec["model"]
        unusual = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "fuse_unk")
        #: Whether words can be encoded by themselves.
        self.by_words = spec["normalizer"] is None and pieces.get("type") == "ByteLevel" and not pieces.get("add_prefix_space") and pieces.get("use_regex", True) and model["type"] == "BPE" and not any(model.get(k) for k in unusual)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.words = Words()

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts can't be cut."""
        whole = np.zeros(len(offsets) - 1, dtype=bool)
        if not self.by_words:
            return ~whole
        raw = data.tobytes()
        found = [m.start() for t in self.added for m in re.finditer(re.escape(t), raw)]
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(_ODD_LEAD[data]), side="right") - 1):
            if _ODD.search(raw[offsets[i] : offsets[i + 1]].decode(errors="replace")):
                whole[i] = True
        whole[np.searchsorted(offsets, found, side="right") - 1] = True
        return whole

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words begin, and the end.

        White space before a word is cut off but for its last character, and that too unless it is a space, which belongs to the word: so does the
        pattern. Marks are cut from a letter or digit before them.
        """
        cut = np.zeros(len(data) + 1, dtype=bool)
        blank, solid = _BLANK[data], _ALNUM[data]
        solid[1:] |= _ACCENTED[data[1:]] & (data[:-1] == 0xC3)
        stop = np.append(~blank[1:], False)  # a word follows, in the same text
        stop[offsets[1:-1] - 1] = False
        before, now = blank[:-1], blank[1:]
        cut[1:-1] = (now & (~before | stop[1:])) | (before & ~now & (data[:-1] != 32)) | (_MARK[data[1:]] & solid[:-1])
        whole = self._whole(data, offsets)
        for lo, hi in zip(offsets[:-1][whole].tolist(), offsets[1:][whole].tolist(), strict=True):
            cut[lo:hi] = False
        cut[offsets] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, given in a row, and how many each has."""
        ends = np.cumsum(size)
        begin = ends - size
        letter = _LETTER[data]
        letter[:-1] |= (data[:-1] == 0xC3) & _ACCENTED[data[1:]]
        letter[1:] |= _ACCENTED[data[1:]] & (data[:-1] == 0xC3)
        one = np.zeros(len(size), dtype=bool)  # one piece of the pattern, perhaps after a space: only its merges are left
        for kind in (letter, _DIGIT[data], _MARK[data]):
            other = ~kind
            other[begin[data[begin] == 32]] = False
            count = np.append(0, np.cumsum(other))
            one |= count[ends] == count[begin]
        one &= self.by_words
        spelled, model, out = _SPELLING[data].tobytes().decode("utf-16-le"), self.library.model.tokenize, [[]] * len(size)
        for i, lo, hi in zip(np.flatnonzero(one).tolist(), begin[one].tolist(), ends[one].tolist(), strict=True):
            out[i] = [t.id for t in model(spelled[lo:hi])]
        rest, raw = np.flatnonzero(~one), data.tobytes()
        texts = [raw[lo:hi].decode(errors="replace") for lo, hi in zip(begin[rest].tolist(), ends[rest].tolist(), strict=True)]
        for i, e in zip(rest.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = e.ids
        return np.fromiter((x for ids in out for x in ids), dtype=np.int32), np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive texts in a row, each with the end id, and how many each has."""
        texts = len(offsets) - 1
        at = self._cuts(data, offsets) if len(data) else np.zeros(1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        values, which = coded.dictionary, coded.indices.to_numpy()
        ends = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
        spelled = np.frombuffer(values.buffers()[2] or b"", np.uint8)[: ends[-1]]
        size = np.diff(ends)
        h = span_hashes(prefix_hashes(spelled), ends[:-1], ends[1:])
        if self.words.nbytes() > TABLE_BYTES:
            self.words = Words()
        known = self.words
        entry = known.find(h, spelled, ends[:-1], size)
        new = np.flatnonzero(entry < 0)
        told = spelled[_ragged(ends[new], size[new])]
        ids, n = self._learn(told, size[new])
        first, count = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        old = entry >= 0
        first[old], count[old] = known.first[entry[old]], known.n[entry[old]]
        first[new], count[new] = len(known.ids) + np.cumsum(n) - n, n
        flat, per = np.append(known.ids, ids), count[which]
        out = flat[_ragged(first[which], per)]
        kept = np.flatnonzero(size[new] <= WORD_BYTES)
        if len(kept):
            begin = np.cumsum(n) - n
            known.add(h[new[kept]], spelled[_ragged(ends[new[kept]], size[new[kept]])], size[new[kept]], ids[_ragged(begin[kept], n[kept])], n[kept])
        total = np.append(0, np.cumsum(per))[np.searchsorted(at, offsets)]
        length = np.diff(total)
        done = np.full(len(out) + texts, END, dtype=np.int32)
        done[np.arange(len(out)) + np.repeat(np.arange(texts), length)] = out
        return done, length + 1


_ENCODERS: dict[str, Encoder] = {}


def _encode(path: str):
    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path] = Encoder(path)
        encoder, shard, seq = _ENCODERS[path], TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, data, offsets in chunks(b.column(1), BATCH_BYTES):
                ids, n = encoder.encode(data, offsets)
                m = len(n)
                rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))
                more = [x.slice(lo, m) for x in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard, np.int32)), pa.array(np.arange(seq, seq + m)), b.column(0).slice(lo, m), pa.array(n.astype(np.int32)), rows, *more], names=["shard", "seq", "doc_id", "n_tokens", "ids", "weight"][: 5 + len(more)])
                seq += m
        pa.default_memory_pool().release_unused()  # the worker stays, and so would what its pool holds

    return run


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes ORC files under path, in ascending doc_id."""
    weighted = "weight" in docs.columns
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col("weight").cast("double")] if weighted else []))
    dealt = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(_encode(vocabulary_path or vocabulary()), COLUMNS + WEIGHT * weighted).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return spark.read.schema(COLUMNS + WEIGHT * weighted).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int], weighted: bool = False) -> DataFrame:
    """The rows of a few documents; stripes and row groups that can't hold them are skipped."""
    return read(spark, path, weighted).where(F.col("doc_id").isin(doc_ids))


def _sums(batches):
    for b in batches:
        ids = b.column(4)
        at = ids.offsets.to_numpy()
        raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).tobytes()
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "seq", "doc_id", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = read(spark, path)
    sums = sorted(files.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).collect())  # a number for each file
    before, total = [], 0
    for r in sums:
        before.append((r.shard, total))
        total += r.n
    offsets = F.broadcast(spark.createDataFrame(before, "shard int, before long"))
    rows = files.mapInArrow(_sums, "shard int, seq long, doc_id long, n_tokens long, ids_crc32 long").join(offsets, "shard")
    own = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", (F.col("before") + F.coalesce(own, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-ids") + ".orc"
    write(docs, path, vocabulary_path)
    with small_batches(docs.sparkSession):
        return cut(summary(docs.sparkSession, path))
