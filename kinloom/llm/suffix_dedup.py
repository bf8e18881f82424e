"""Removal of repeated passages of text by a distributed suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Sorting every suffix
of the corpus would move each byte ``length`` times, so only strings that can repeat are sorted:

1. Documents are packed in chunks. Each string of ``length`` bytes is named by the least hash among its substrings of ``gram`` bytes (its
   minimizer), so equal strings have equal names and neighbouring strings mostly share theirs. Names go to buckets by hash; a bucket
   tells each chunk which of its names occur in more than one document.
2. Runs of neighbouring strings with such a name become segments. Equal segments of a chunk are sent once, with their smallest doc_id, to the
   name's bucket. There the suffixes at which strings start are sorted in two stages (suffix_sort.py), adjacent suffixes
   that share ``length`` bytes form a class, and the class's smallest doc_id decides. One bit per string returns to the chunk.
3. Chunks drop the covered bytes.

The hash only chooses where to look: equality is always that of bytes. A name with more than ``hot_docs`` documents is
spread: its strings travel singly, to the bucket of their own hash. Copies are combined per chunk before each shuffle.

A document longer than a chunk is cut into pieces that share ``length`` - 1 bytes, so every string lies whole in the piece in which it starts; the
pieces' verdicts are put together at the end, where only such documents' bytes are in one place.

Defined results: a null text counts as empty; documents of one repeated doc_id do not remove each other's bytes; a null doc_id is larger
than every other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored
from kinloom.llm.suffix_sort import PAD, share_prefix, sorted_suffixes, words_at

CHUNK = "chunk long, n_bytes long, ids binary, sizes binary, text binary, whole long, part int, own long, no_id boolean"
NO_ID = np.iinfo(np.int64).max
MOST_TASKS = 8192
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    return h


def _hashes(text: np.ndarray, span: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the ``span`` (8 or more) bytes at each position, or at those given."""
    words = words_at(text, "<u8")
    n = len(text) - span + 1
    out = None
    for offset in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        word = words[offset : offset + n] if at is None else words[at + offset]
        if out is None:
            out = word.astype(np.uint64)
        else:
            out *= _P
            out += word
        out ^= out >> np.uint64(31)
        out *= _R
    return _mix(out)


def _packed(data: bytes) -> bytes:
    """Compressed here, since what is shuffled repeats itself much farther than the codec of shuffle files looks."""
    return zstandard.compress(data, 3)


def _unpacked(data: bytes) -> bytes:
    return zstandard.decompress(bytes(data))


class Chunk:
    """The runs of strings with one name in a chunk of documents."""

    def __init__(self, row, length: int, gram: int, bits: int):
        self.length, self.bits = length, bits
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.text = np.frombuffer(_unpacked(row["text"]) + bytes(PAD), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        least = _hashes(self.text, gram)
        span, window = 1, length - gram + 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        held = self.sizes >= length
        first, count = self.begin[held], self.sizes[held] - length + 1
        place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        name = least[place]
        start = np.ones(len(place), bool)
        start[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1] + 1)
        start[np.cumsum(count)[:-1]] = True
        at = np.flatnonzero(start)
        self.run_at, self.run_size = place[at], np.diff(np.append(at, len(place)))
        self.run_name = _mix(name[at] * _P)
        self.run_doc = np.searchsorted(self.begin, self.run_at, "right") - 1
        while (empty := self.sizes[self.run_doc] == 0).any():  # of documents at one place, only one has bytes
            self.run_doc[empty] -= 1
        self.names, self.run_of = np.unique(self.run_name, return_inverse=True)

    def buckets(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(names), np.int64)

    def docs_per_name(self) -> np.ndarray:
        pair = np.unique(self.run_of * len(self.ids) + self.run_doc)
        return np.bincount(pair // max(1, len(self.ids)), minlength=len(self.names))

    def segments(self, flags: np.ndarray) -> dict[int, tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]]:
        """By bucket: the distinct segments in order of their first run; the runs' segment numbers, places and sizes; flags: 0 no, 1 yes, 2 hot."""
        flag = flags[self.run_of]
        cold, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        at, size, doc = self.run_at[cold], self.run_size[cold], self.run_doc[cold]
        bucket = self.buckets(self.run_name[cold])
        if len(hot):
            n = self.run_size[hot]
            single = np.repeat(self.run_at[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at, size = np.concatenate([at, single]), np.concatenate([size, np.ones(len(single), np.int64)])
            doc = np.concatenate([doc, np.repeat(self.run_doc[hot], n)])
            bucket = np.concatenate([bucket, self.buckets(_hashes(self.text, self.length, single))])
        order = np.argsort(bucket, kind="stable")
        at, size, doc, bucket = at[order], size[order], doc[order], bucket[order]
        data = self.text.tobytes()
        stop = at + size + self.length - 1
        out = {}
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(at)), strict=True):
            if lo == hi:
                continue
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(at[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True)])
            out[int(bucket[lo])] = (known, number, at[lo:hi], doc[lo:hi])
        return out


def _pack(documents: DataFrame, chunk_bytes: int, length: int) -> DataFrame:
    """Chunks of whole documents, and pieces of those longer than a chunk: whole names the document, own is the number of bytes before the next piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, texts, size = 0, [], [], 0

        def chunk(ids, texts, whole=None, part=None, own=None, no_id=None):
            nonlocal made
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            sizes = np.array([len(t) for t in texts], np.int64)
            cols = [[number], [int(sizes.sum())], [np.array(ids, np.int64).tobytes()], [sizes.tobytes()], [_packed(b"".join(texts))], [whole], [part], [own], [no_id]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                data = text.as_py() or b""
                if len(data) > chunk_bytes:
                    whole = (TaskContext.get().partitionId() << 32) + made
                    for part, at in enumerate(range(0, len(data), chunk_bytes)):
                        piece = data[at : at + chunk_bytes + length - 1]
                        yield chunk([NO_ID if doc is None else doc], [piece], whole, part, min(chunk_bytes, len(data) - at), doc is None)
                    continue
                if texts and size + len(data) > chunk_bytes:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(NO_ID if doc is None else doc)
                texts.append(data)
                size += len(data)
        if texts:
            yield chunk(ids, texts)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK)


def _names(length: int, gram: int, bits: int):
    """Each chunk's names by bucket: 48 bits of each (the bucket has the rest of the order), and the documents of the chunk that have it, up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, length, gram, bits)
                docs = np.minimum(chunk.docs_per_name(), 255).astype(np.uint8)
                bucket = chunk.buckets(chunk.names)
                low = (chunk.names << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                bounds = list(zip(np.append(0, cut), np.append(cut, len(bucket)), strict=True)) if len(bucket) else []
                cols = [
                    pa.array([int(bucket[a]) for a, _ in bounds], pa.int64()),
                    pa.array([row["chunk"]] * len(bounds), pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in bounds], pa.binary()),
                    pa.array([docs[a:b].tobytes() for a, b in bounds], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "names", "docs"])

    return run


def _flag(hot_docs: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in pdf["names"]]
        sizes = [len(x) for x in names]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, 2:] = np.concatenate(names)
        docs = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["docs"]])
        _, of = np.unique(wide.view(">u8").ravel().astype(np.uint64), return_inverse=True)
        total = np.bincount(of, weights=docs)
        flag = np.where(total > hot_docs, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[of]
        parts = np.split(flag, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "kind": 0, "data": [x.tobytes() for x in parts]})

    return run


MARKS = "chunk long, bucket long, kind int, data binary"


def _flags_of(chunk: Chunk, marks: pd.DataFrame) -> np.ndarray:
    mine = marks[marks["kind"] == 0].sort_values("bucket")
    return np.frombuffer(b"".join(mine["data"]), np.uint8) if len(mine) else np.zeros(len(chunk.names), np.uint8)


def _segments(length: int, gram: int, bits: int):
    def run(chunks: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in chunks.iterrows():
            chunk = Chunk(row, length, gram, bits)
            for bucket, (known, number, _, doc) in chunk.segments(_flags_of(chunk, marks)).items():
                least = np.full(len(known), NO_ID)
                np.minimum.at(least, number, chunk.ids[doc])
                sizes = np.fromiter(map(len, known), np.int32, len(known))
                rows.append((bucket, int(row["chunk"]), sizes.tobytes(), least.tobytes(), _packed(b"".join(known))))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "sizes", "least", "text"])

    return run


def _judge(length: int):
    """In a bucket: which strings of each segment also start in a document with an id below the segment's own smallest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}  # chunks that hold the same segment share it
        numbers, leasts = [], []
        for packed, sizes, least in zip(pdf["text"], pdf["sizes"], pdf["least"], strict=True):
            data, stop = _unpacked(packed), np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)
            start = np.append(0, stop[:-1])
            numbers.append(np.array([known.setdefault(data[x:y], len(known)) for x, y in zip(start.tolist(), stop.tolist(), strict=True)], np.int64))
            leasts.append(np.frombuffer(least, np.int64))
        number, least = np.concatenate(numbers), np.concatenate(leasts)
        lowest = np.full(len(known), NO_ID)
        np.minimum.at(lowest, number, least)
        size = np.fromiter(map(len, known), np.int64, len(known))
        text = np.frombuffer(b"".join(known) + bytes(PAD), np.uint8)
        begin, count = np.cumsum(size) - size, size - length + 1
        first = np.cumsum(count) - count
        place = np.repeat(begin - first, count) + np.arange(int(count.sum()))
        chosen = np.zeros(len(text), bool)
        chosen[place] = True
        order = sorted_suffixes(text, chosen, length)
        string = np.empty(len(text), np.int32)
        string[place] = np.arange(len(place), dtype=np.int32)
        string = string[order]
        starts = np.append(0, np.flatnonzero(~share_prefix(text, order, length)) + 1)
        smallest = np.empty(len(place), np.int64)
        smallest[string] = np.repeat(np.minimum.reduceat(np.repeat(lowest, count)[string], starts), np.diff(np.append(starts, len(string))))
        data = []
        for own, low in zip(numbers, leasts, strict=True):
            n = count[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            data.append(np.packbits(smallest[at] < np.repeat(low, n)).tobytes())
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "kind": 1, "data": data})

    return run


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
PIECE = "whole long, part int, mask binary"


def _spans(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(len(mask) and mask[0]))


def _kept(data: np.ndarray, mask: np.ndarray, digest: bool) -> bytes:
    kept = (data[~mask] if mask.any() else data).tobytes()
    return hashlib.sha256(kept).hexdigest().encode() if digest else kept


def _join_pieces(digest: bool):
    """A cut document from its pieces: a byte goes if any piece that has it says so."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        size = int(pdf["n_bytes"].sum())
        data, gone, at = np.empty(size, np.uint8), np.zeros(size, bool), 0
        for own, text, mask in zip(pdf["n_bytes"], pdf["kept"], pdf["mask"], strict=True):
            data[at : at + own] = np.frombuffer(text, np.uint8)[:own]
            mask = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(text)).astype(bool)
            gone[at : at + len(mask)] |= mask
            at += own
        row = (pdf["doc_id"].iloc[0], size, int(gone.sum()), _spans(gone), _kept(data, gone, digest))
        return pd.DataFrame([row], columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    return run


def _drop(length: int, gram: int, bits: int, digest: bool):
    def run(chunks: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in chunks.iterrows():
            chunk = Chunk(row, length, gram, bits)
            places = [np.empty(0, np.int64)]
            judged = {int(b): x for b, x, k in zip(marks["bucket"], marks["data"], marks["kind"], strict=True) if k == 1}
            for bucket, (known, number, at, doc) in chunk.segments(_flags_of(chunk, marks)).items():
                count = np.fromiter(map(len, known), np.int64, len(known)) - length + 1
                bit = np.unpackbits(np.frombuffer(judged[bucket], np.uint8), count=int(count.sum())).astype(bool)
                least = np.full(len(known), NO_ID)
                np.minimum.at(least, number, chunk.ids[doc])
                first, n = (np.cumsum(count) - count)[number], count[number]
                total, inner = np.cumsum(n) - n, np.arange(int(n.sum()))
                repeated = bit[np.repeat(first - total, n) + inner] | np.repeat(chunk.ids[doc] > least[number], n)
                places.append((np.repeat(at - total, n) + inner)[repeated])
            change = np.zeros(len(chunk.text) + 1, np.int8)  # a string starts at a place once
            place = np.concatenate(places)
            change[place] += 1
            change[place + length] -= 1
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            if not pd.isna(row["whole"]):
                data, mask = chunk.text[: int(chunk.sizes[0])], gone[: int(chunk.sizes[0])]
                rows.append((None if row["no_id"] else int(chunk.ids[0]), int(row["own"]), 0, 0, data.tobytes(), int(row["whole"]), int(row["part"]), np.packbits(mask).tobytes()))
                continue
            for doc, begin, size in zip(chunk.ids.tolist(), chunk.begin.tolist(), chunk.sizes.tolist(), strict=True):
                mask = gone[begin : begin + size]
                kept = _kept(chunk.text[begin : begin + size], mask, digest)
                rows.append((None if doc == NO_ID else doc, size, int(mask.sum()), _spans(mask), kept, None, None, None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "whole", "part", "mask"])
        return out.astype({"doc_id": "Int64", "whole": "Int64", "part": "Int32"})

    return run


def _marks(chunks: DataFrame, length: int, gram: int, bits: int, hot_docs: int, parts: int) -> DataFrame:
    names = chunks.mapInArrow(_names(length, gram, bits), "bucket long, chunk long, names binary, docs binary")
    return stored(names.repartition(parts, "bucket").groupBy("bucket").applyInPandas(_flag(hot_docs), MARKS), "flags")


def _by_chunk(chunks: DataFrame, marks: DataFrame, parts: int):
    return chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(marks.repartition(parts, "chunk").groupBy("chunk"))


def _judged(chunks: DataFrame, flags: DataFrame, length: int, gram: int, bits: int, parts: int) -> DataFrame:
    rows = _by_chunk(chunks, flags, parts).applyInPandas(_segments(length, gram, bits), "bucket long, chunk long, sizes binary, least binary, text binary")
    return stored(rows.repartition(parts, "bucket").groupBy("bucket").applyInPandas(_judge(length), MARKS), "judged")


def remove_repeats(
    documents: DataFrame, length: int = 50, gram: int = 20, chunk_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, hot_docs: int = 16_384, digest: bool = False, task_bytes: int = 4 << 20
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document; kept holds the bytes left, or their SHA-256 in hex with ``digest``. A shuffled task takes about ``task_bytes`` of text, and up to 16 times as much where there would be more than MOST_TASKS."""
    chunks = stored(_pack(documents, chunk_bytes, length), "chunks")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, (size // bucket_bytes).bit_length())
    parts = max(1, min(-(-size // task_bytes), max(MOST_TASKS, -(-size // (16 * task_bytes)))))
    flags = _marks(chunks, length, gram, bits, hot_docs, parts)
    judged = _judged(chunks, flags, length, gram, bits, parts)
    done = _by_chunk(chunks, flags.unionByName(judged), parts).applyInPandas(_drop(length, gram, bits, digest), f"{KEPT}, {PIECE}")
    if chunks.where("whole is not null").isEmpty():
        return done.drop("whole", "part", "mask")
    done = stored(done, "kept")
    long = done.where("whole is not null").groupBy("whole").applyInPandas(_join_pieces(digest), KEPT)
    return done.where("whole is null").drop("whole", "part", "mask").unionByName(long)
