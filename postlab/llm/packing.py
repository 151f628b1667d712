"""Operator 4, best-fit packing by the sum of squares.

A document is its token ids and one end id. Longer ones than ``capacity`` are cut into full pieces, of which
the first may be shorter; full pieces are sequences by themselves, so each document leaves one piece to
pack at most. Packing follows the sum-of-squares rule: with N(g) open sequences of residual gap g, a piece goes
where the sum of N(g)**2 becomes smallest (ties: the smallest gap); a perfect fit closes its sequence.

At scale: tokenization is one map over the documents; what is shuffled is one narrow row per document
(id, length, checksums of its pieces), written with a number. Documents are dealt evenly by a hash of that number, so
equal rows spread too, into groups of about ``group_docs`` rows, and each group is packed by itself, longest piece first. A group leaves few open
sequences, so the loss against packing everything at once is a fraction of a percent, and no task ever
holds more than a group. The number of groups follows the number of documents.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed one by one, ids may have
any type that reads back from its text; an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import written

CAPACITY = 2048
END_ID = 0
GROUP_DOCS = 3072


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(ids: bytes, capacity: int) -> list[bytes]:
    """A document's little-endian ids cut into full pieces; the first takes the rest."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    return [ids[:4 * first]] + [ids[4 * i:4 * (i + capacity)] for i in range(first, n, capacity)]


def tokenized(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """(row_id, n, crcs): number of ids with the end id, and the checksum of each piece."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlab.llm.tokens import PieceIds

        encoder, end = PieceIds(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(1):
                ids = encoder.ids(text.as_py() or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(p) for p in pieces_of(ids, capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                                             names=["row_id", "n", "crcs"])

    return docs.select(F.col(id_col).alias("row_id"), F.col(text_col)).mapInArrow(
        run, f"row_id {id_type}, n long, crcs array<long>")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order by the sum-of-squares rule.

    Putting a piece of size s into a gap g changes the sum of squares by 2 * (N(g - s) - N(g)) + 2, opening a
    sequence by 2 * N(capacity - s) + 1, and closing one by 1 - 2 * N(s)."""
    count = np.zeros(capacity + 1, np.int64)  # N(g) for 0 < g < capacity; N(0) stays 0
    members: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        gaps = count[s:capacity]
        change = np.where(gaps > 0, 2 * (count[:capacity - s] - gaps) + 2, never)
        if s < capacity and gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= new:
            gap = s + best
            at = members[gap].pop()
            count[gap] -= 1
        else:
            gap, at, opened = capacity, opened, opened + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > s:
            members[gap - s].append(at)
            count[gap - s] += 1
    return sequence, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         group_docs: int = GROUP_DOCS, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    id_type = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).cast("string").alias("row_id"), F.col(text_col).alias("row_text"))
    rows = tokenized(named, "row_id", "row_text", capacity, path or tokenizer_path())
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "pack-rows")
    groups = max(1, -(-rows.count() // group_docs))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("uid"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        first = (n - 1) % capacity + 1
        order = np.lexsort((pdf["uid"].to_numpy(), -first))
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        sequence[order], offset[order] = pack_lengths(first[order], capacity)
        pieces = (n - first) // capacity + 1
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        is_first = piece == 0
        used = int(sequence.max()) + 1
        number = np.where(is_first, sequence[doc], used + np.cumsum(~is_first) - 1)
        return pd.DataFrame({
            id_col: pdf["row_id"].to_numpy()[doc], "piece": piece.astype(np.int32),
            "start": np.where(is_first, 0, first[doc] + (piece - 1) * capacity),
            "length": np.where(is_first, first[doc], capacity),
            "ids_crc32": np.concatenate(pdf["crcs"].to_list()),
            "sequence_id": (np.int64(key[0]) << 32) + number,
            "offset": np.where(is_first, offset[doc], 0)})

    packed = rows.groupBy("pack_group").applyInPandas(
        run, f"`{id_col}` string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumn(id_col, F.col(id_col).cast(id_type))
