"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Texts become token ids (one end id is added), and only documents longer than a sequence are cut; the first piece takes the remainder,
so every other piece fills a sequence by itself. What is left is bin packing of the remainders:

1. Remainders are dealt by hash to partitions of bounded size; each runs best-fit decreasing.
2. Each partition gets a lower bound on its number of bins: the best of several families of dual-feasible functions over its
   histogram of lengths. A partition that meets its bound is certified optimal and done.
3. Partitions with a gap keep their full bins and exchange the documents of all other bins: these are dealt anew among fewer, fuller
   partitions, and best-fit decreasing runs again. A partition that has no partner left, or the last round, ends it.

Only one small row per piece is shuffled, never text or ids. Each round is a table in the shared folder.

Defined results: a null text counts as empty and gives one piece holding the end id; rows with a null or repeated doc_id are each
packed; an empty table gives no rows; other columns are ignored, unless they are to be carried. Strings of added tokens inside texts are what the
tokenizer's plain call makes of them. Long texts are encoded in parts, cut where no id can change.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters on whose classes all versions of Unicode agree.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u2010-\u2027\u20ac]*")
#: A longer text is encoded in parts, to bound the memory of a task, cut between two ASCII words.
PART_CHARS = 1 << 20
BETWEEN = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
AUDITED = 64  # one text in so many is encoded by both libraries


def text_parts(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters, cut only between two ASCII words; a text without such places stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        cut = BETWEEN.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _cuts_are_safe(tokenizer) -> bool:
    """Whether cutting where a byte-level pattern ends a word can't change the ids: no normaliser, and no added token that takes in white space."""
    told = json.loads(tokenizer.to_str())
    split = told["pre_tokenizer"] or {}
    level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in told["added_tokens"])
    return level and told["normalizer"] is None and added


class Encoder:
    """Texts to the ids of the tokenizer's plain call. With a ranks file of the same vocabulary, texts of plain characters without added tokens take a library that is six times as fast; a sample of them takes both, and must agree."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(tokenizer_path)
        self.own.no_truncation()
        self.own.no_padding()
        self.safe = _cuts_are_safe(self.own)
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.fast, self.seen = None, 0
        if ranks_path is not None and self.safe:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS or not self.safe:
            return self.own.encode(text, add_special_tokens=False).ids
        return [x for part in text_parts(text, PART_CHARS) for x in self.own.encode(part, add_special_tokens=False).ids]

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or not PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self.whole(text)
        ids = self.fast.encode_ordinary(text)
        self.seen += 1
        if self.seen % AUDITED == 1 and len(text) <= PART_CHARS and ids != self.whole(text):
            raise ValueError("the ranks file and the tokenizer give different ids")
        return ids


@lru_cache(maxsize=4)
def _encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, pattern)


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, sequence: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece of each document: (doc_id, piece, start, length, ids_crc32), the columns to carry, and ``ids`` on request."""

    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            texts, own, rows, ids_of = batch.column("text"), [], [], []
            for i in range(batch.num_rows):
                ids = np.array(encode(texts[i].as_py() or "") + [end_id], "<u4")
                first = (len(ids) - 1) % sequence + 1
                starts = [0, *range(first, len(ids), sequence)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    own.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        ids_of.append(ids[a:b].astype(np.int32))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            kept = batch.drop_columns(["text"]).take(pa.array(own, pa.int64()))
            cols = [kept.column(0), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *kept.columns[1:]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *carry]
            if with_ids:
                ends = np.cumsum([0, *length], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids_of) if ids_of else np.empty(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = [f"`{c}` {held.schema[c].dataType.simpleString()}" for c in carry]
    return held.mapInArrow(run, ", ".join([PIECES, *kinds, *(["ids array<int>"] if with_ids else [])]))


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins of this size needed at least for counts[x] items of each length x: the best of three families of dual-feasible functions."""
    x = np.arange(size + 1)
    best = -(-int((counts * x).sum()) // size)
    n, total = np.cumsum(counts), np.cumsum(counts * x)
    for e in range(1, size // 2 + 1):  # long items count whole, short ones nothing
        long_n = int(n[size] - n[size - e])
        mid = int(total[size - e] - total[e - 1])
        best = max(best, long_n + -(-mid // size))
    for k in range(1, 65):  # lengths rounded to k-ths, except where they divide evenly
        even = (k + 1) * x % size == 0
        value = np.where(even, k * x, ((k + 1) * x // size) * size)
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    for e in range(1, size // 2):  # items in units of e, as many as fit beside a long one
        units = size // e
        value = np.where(2 * x > size, 2 * (units - (size - x) // e), np.where(2 * x == size, units, 2 * (x // e)))
        best = max(best, -(-int((counts * value).sum()) // (2 * units)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    has_room, n = 0, 0  # bit r of has_room: some bin has exactly r left
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = has_room >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                has_room ^= 1 << room
        else:
            room, at, n = size, n, n + 1
        bins[i], offsets[i] = at, size - room
        left = room - length
        if not open_by_room[left]:
            has_room |= 1 << left
        open_by_room[left].append(at)
    return bins, offsets, n


PACKED = "uid long, length long, sequence_id long, offset long, room long, part long, bins long, bound long"


def _pack_round(items: DataFrame, parts: int, round_no: int, size: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, size)
        used = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        part = int(pdf["part"].iloc[0])
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        return pd.DataFrame(
            {"uid": pdf["uid"], "length": lengths, "sequence_id": (round_no << 56) + (part << 24) + bins, "offset": offsets, "room": size - used[bins], "part": part, "bins": n, "bound": bound}
        )

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(parts)).alias("part"))
    return stored(dealt.groupBy("part").applyInPandas(run, PACKED), "packed")


def pack_remainders(items: DataFrame, size: int = 1024, part_rows: int = 100_000, rounds: int = 4) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid, length), each shorter than size."""
    parts, done, pool = max(1, -(-items.count() // part_rows)), None, items
    for round_no in range(rounds):
        packed = _pack_round(pool, parts, round_no, size)
        each = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        gaps, with_gap = each.agg(F.sum(F.col("bins") - F.col("bound")), F.count_if(F.col("bins") > F.col("bound"))).first()
        last = not gaps or with_gap < 2 or round_no == rounds - 1
        kept = (packed if last else packed.where("bins <= bound or room = 0")).select("uid", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        pool = packed.where("bins > bound and room > 0").select("uid", "length")
        parts = max(1, min(with_gap - 1, -(-pool.count() // part_rows)))
    return done


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    sequence: int = 1024,
    end_id: int = 2,
    ranks_path: str | None = None,
    pattern: str | None = None,
    part_rows: int = 100_000,
    rounds: int = 4,
    with_ids: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, carried columns, ids on request, sequence_id, offset) for every piece of every document."""
    pieces = tokenize_pieces(documents, tokenizer_path, sequence, end_id, ranks_path, pattern, with_ids, carry)
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == sequence).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < sequence)
    placed = pack_remainders(rest.select("uid", "length"), sequence, part_rows, rounds)
    return full.unionByName(rest.join(placed, "uid").select(full.columns)).drop("uid")
