"""Operator 13, alignment of two tokenizations of each text and a corpus-wide table of linked ids.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte fallback) the text, to which it
adds that space itself. Byte offsets where tokens of both end cut the text into groups; every A and B token
of a group are linked.

Offsets come from the libraries: character spans of the tokenizers library and byte spans of the sentencepiece proto (the
installed library has replaced its immutable proto by it). They are right wherever a token ends between two characters;
a token that ends inside a character, a byte-fallback piece or a span without blanks is refined by the decoded
bytes of its id. Texts whose decoded bytes differ from space+text have no tokens.

1. One map encodes the texts and forms groups and links in numpy over many texts at once. Per document it writes the
   distinct linked pairs as places in a list of pairs that a block of documents shares, so a pair is spelled out
   once a block. A block holds about ``BLOCK_PAIRS`` pairs, or one document. The table is written: texts are encoded once.
2. The blocks' lists (pair, number of documents) are summed by pair, with a map-side sum; each pair gets the largest count
   of its A id, and the counts go back to the blocks by a join on the pair. Both are shuffles of a row per block and pair.
3. Each block meets its counts, and its documents look their pairs up by place.

Texts are encoded in units, each distinct one once while a worker remembers it: a text is cut in front of a space
between visible characters, in front of a line feed between them, and in front of the marks that end a unit of letters.
Neither tokenizer joins there: A's words begin at these places, and no piece of B crosses one (checked when the model is
loaded; otherwise texts stay whole). So both have a token end there, groups never cross it, and a text's groups, links and
digest are put together from its units'. A worker keeps at most about ``CACHE_UNITS`` units, and when there are more, those met most often.
A group whose links are many is counted by its distinct ids, not link by link.

Defined results: null and empty texts, and texts that do not decode to themselves, have zeros and an empty
``groups_sha256``; repeated rows and null ids are documents of their own; strings of special tokens are plain text; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import written

#: Distinct pairs of a document, summed over the documents of a block.
BLOCK_PAIRS = 2_000_000
#: Characters of text aligned together.
TOGETHER = 1 << 21
#: Units kept by a worker, and distinct pairs of a unit on average.
CACHE_UNITS, UNIT_PAIRS = 400_000, 16
#: A group with more links is counted by its distinct ids.
MANY_LINKS = 1 << 12
#: Bits of an id.
ID_BITS = 20
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
MARKS = frozenset(".,!?;:")
#: In front of a unit's key; no unit but a text's first begins with two line feeds.
MARKED, SPACED = "\n\n", "\n\n\n"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the others for 256 and up, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoders:
    """Both tokenizers with the decoded bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols, entries = byte_symbols(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in found], np.int64) for found in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) >> ID_BITS:
            raise ValueError(f"ids need {ID_BITS} bits")
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i))]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in plain)
        #: Marks that no piece holds behind a letter.
        self.marks = MARKS - {m for p in plain for c, m in zip(p, p[1:], strict=False) if c.isalpha()} if self.cuts else frozenset()
        self.stripped = "".join(sorted(self.marks))

    def units(self, text: str) -> list[str]:
        """The text's units: the first and those behind a space without that space, a line's first with its line feed."""
        if not self.cuts:
            return [text]
        if ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n"
                or any(b in text for b in BLANKS)):
            return CUT.split(text)
        return text.replace("\n", " \n").split(" ")

    def encoded(self, units: list[tuple[str, str]]) -> tuple[list[bool], list[np.ndarray]]:
        """Whether both tokenizers leave each unit's bytes as they are; ids, ends and unit numbers of the tokens of A and B of
        those units, the ends in the units' joined bytes. A unit comes with what stands in front of it: a space, nothing (a
        line feed begins it) or a line feed that is not its own."""
        spelled = [f" {u}" if front == " " else u for u, front in units]
        a = self.a.encode_batch(spelled, add_special_tokens=False)
        b = [x.pieces for x in self.b.encode([f"\n{u}" if front == "\n" else u for u, front in units], return_type="proto", num_threads=1)]
        # B begins with its own space, then the line feed put in front
        skip = {" ": 0, "": 1, "\n": 2}
        ids_a, ids_b = [x.ids for x in a], [[p.id for p in x[skip[front]:]] for x, (_, front) in zip(b, units, strict=True)]
        raw = [t.encode() for t in spelled]
        together = (b"".join(map(found.__getitem__, chain.from_iterable(ids))) for found, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        whole = [True] * len(units)
        if any(x != b"".join(raw) for x in together):
            whole = [b"".join(map(self.bytes_a.__getitem__, i)) == r == b"".join(map(self.bytes_b.__getitem__, j))
                     for i, j, r in zip(ids_a, ids_b, raw, strict=True)]
        good = [k for k, ok in enumerate(whole) if ok]
        joined = "".join(spelled[k] for k in good)
        n_a, n_b = np.array([len(ids_a[k]) for k in good], np.int64), np.array([len(ids_b[k]) for k in good], np.int64)
        unit_a, unit_b = np.repeat(np.arange(len(good)), n_a), np.repeat(np.arange(len(good)), n_b)
        all_a, all_b = (np.fromiter(chain.from_iterable(x[k] for k in good), np.int64) for x in (ids_a, ids_b))
        first_char = np.cumsum([0, *(len(spelled[k]) for k in good)])
        ends_a = np.fromiter((end for k in good for _, end in a[k].offsets), np.int64, len(all_a)) + first_char[unit_a]
        if not joined.isascii():
            ends_a = _byte_places(joined)[ends_a]
        first_byte = np.cumsum([0, *(len(raw[k]) for k in good)]) + np.array([1 - skip[units[k][1]] for k in good] + [0])
        ends_b = np.fromiter((p.end for k in good for p in b[k][skip[units[k][1]]:]), np.int64, len(all_b)) + first_byte[unit_b]
        return whole, [all_a, _refined(ends_a, self.length_a[all_a]), unit_a, all_b, _refined(ends_b, self.length_b[all_b]), unit_b]


def _byte_places(text: str) -> np.ndarray:
    """Byte offset of every character offset, the end included."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)])


def _refined(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of spans, with those that are no end of the decoded bytes (inside a character, byte fallback, spans without
    their blanks) taken from the bytes."""
    decoded = np.cumsum(lengths)
    odd = ends != decoded
    if odd.any():
        ends[odd] = decoded[odd]
    return ends


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..most-1, right-aligned over zero bytes, and their number."""
    width = len(str(most - 1))
    text = [str(i).rjust(width, "\0") for i in range(most)]
    return np.frombuffer("".join(text).encode(), np.uint8).reshape(most, width), np.array([len(t.lstrip("\0")) for t in text])


class Growing:
    """Numbers in one array that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 10, np.int64), 0

    def add(self, values) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)

    def put(self, values) -> None:
        """Hold these numbers alone."""
        self.n = 0
        self.add(values)


class Aligner:
    """Groups, links and digests of texts, put together from their units."""

    def __init__(self, encoders: Encoders, limit: int = CACHE_UNITS):
        self.encoders, self.limit = encoders, limit
        self.digits, self.n_digits = _digits(max(len(encoders.bytes_a), len(encoders.bytes_b)))
        #: Unit with its front -> number; by number: its groups spelled out (None if a tokenizer changes it) and figures.
        self.number: dict[str, int] = {}
        self.text: list[str | None] = []
        self.figures = {x: Growing() for x in FIGURES}
        self.first, self.pairs, self.times, self.uses = Growing(), Growing(), Growing(), Growing()
        self.first.add([0])

    def __call__(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Per document: n_a, n_b, n_groups, n_links, digest, and its sorted distinct pairs with their numbers."""
        n = len(texts)
        keys = [self._keys(t) if t else [] for t in texts]
        wanted = dict.fromkeys(k for doc in keys for k in doc if k not in self.number)
        self._learn(list(wanted))
        numbers = [list(map(self.number.__getitem__, doc)) for doc in keys]
        words = [list(map(self.text.__getitem__, doc)) for doc in numbers]
        changed = [None in w for w in words]
        digest = [hashlib.sha256(";".join(w).encode()).hexdigest() if w and not bad else "" for w, bad in zip(words, changed, strict=True)]
        numbers = [[] if bad else x for x, bad in zip(numbers, changed, strict=True)]
        doc = np.repeat(np.arange(n), [len(x) for x in numbers])
        unit = np.fromiter(chain.from_iterable(numbers), np.int64, len(doc))
        out: dict[str, np.ndarray | list] = {"digest": digest}
        for x in FIGURES:
            out[x] = np.zeros(n, np.int64)
            np.add.at(out[x], doc, self.figures[x].data[unit])
        self.uses.data[np.unique(unit)] += 1
        some, seen = np.unique(doc << 40 | unit, return_counts=True)
        doc, unit = some >> 40, some & ((1 << 40) - 1)
        first, size = self.first.data[unit], self.first.data[unit + 1] - self.first.data[unit]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs, place = np.unique(np.repeat(doc, size) << 2 * ID_BITS | self.pairs.data[at], return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, place, self.times.data[at] * np.repeat(seen, size))
        bounds = np.searchsorted(pairs, np.arange(n + 1) << (2 * ID_BITS))
        pairs &= (1 << 2 * ID_BITS) - 1
        out["pairs"] = [pairs[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        out["times"] = [times[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(self.text) > self.limit or self.pairs.n > self.limit * UNIT_PAIRS:
            self._trim()
        return out

    def _keys(self, text: str) -> list[str]:
        """A text's units with what stands in front, as one string: a unit behind a space is itself, one that a line feed
        begins too; letters and closing marks are two units, the marks behind ``MARKED``; a first unit that begins
        with a line feed stands behind ``SPACED``."""
        units = self.encoders.units(text)
        marks, stripped = self.encoders.marks, self.encoders.stripped
        out = [SPACED + units[0] if units[0][:1] == "\n" else units[0]]
        for u in units[1:]:
            if u[-1] in marks:
                letters = u.rstrip(stripped)
                if letters.isalpha():
                    out.append(letters)
                    out.append(MARKED + u[len(letters):])
                    continue
            out.append(u)
        return out

    def _learn(self, keys: list[str]) -> None:
        """Encode new units, all at once."""
        if not keys:
            return
        units = [(k[3:], " ") if k.startswith(SPACED) else (k[2:], "\n") if k.startswith(MARKED) else (k, "" if k[0] == "\n" else " ") for k in keys]
        whole, (ids_a, ends_a, unit_a, ids_b, ends_b, unit_b) = self.encoders.encoded(units)
        n = sum(whole)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        first_a, first_b = np.searchsorted(group_a, np.arange(len(cuts))), np.searchsorted(group_b, np.arange(len(cuts)))
        count_a, count_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        unit = unit_a[first_a] if len(cuts) else np.empty(0, np.int64)
        links = count_a * count_b
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, unit, links)
        pairs, times = self._pairs(ids_a, group_a, first_a, count_a, ids_b, first_b, count_b, unit, links)
        bounds = np.searchsorted(pairs, np.arange(n + 1) << (2 * ID_BITS))
        found = {"n_a": np.bincount(unit_a, minlength=n), "n_b": np.bincount(unit_b, minlength=n), "n_groups": np.bincount(unit, minlength=n),
                 "n_links": n_links, "size": np.diff(bounds)}
        place = np.cumsum(whole) - 1
        ok = np.array(whole)
        for x in (*FIGURES, "size"):  # units that a tokenizer changes have zeros
            every = np.where(ok, found[x][place], 0) if n else np.zeros(len(keys), np.int64)
            self.figures[x].add(every) if x != "size" else self.first.add(self.first.data[self.first.n - 1] + np.cumsum(every))
        self.pairs.add(pairs & ((1 << 2 * ID_BITS) - 1))
        self.times.add(times)
        self.uses.add(np.zeros(len(keys), np.int64))
        texts = iter(self._texts(ids_a, group_a, ids_b, group_b, unit_a, unit_b, n))
        for key, good in zip(keys, whole, strict=True):
            self.number[key] = len(self.text)
            self.text.append(next(texts) if good else None)

    def _trim(self) -> None:
        """Keep the units met in most batches, half as many as allowed at most, and at least two batches each."""
        uses = self.uses.data[:len(self.text)]
        least = 2
        while (uses >= least).sum() > self.limit // 2:
            least += 1
        keep = np.flatnonzero(uses >= least)
        first, size = self.first.data[keep], self.first.data[keep + 1] - self.first.data[keep]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys = list(self.number)  # in the order of their numbers
        self.number = {keys[i]: k for k, i in enumerate(keep.tolist())}
        self.text = [self.text[i] for i in keep.tolist()]
        for x in (*self.figures.values(), self.uses):
            x.put(x.data[keep])
        for x in (self.pairs, self.times):
            x.put(x.data[at])
        self.first.put(np.concatenate([[0], np.cumsum(size)]))
        self.uses.data[:self.uses.n] //= 2

    def _pairs(self, ids_a, group_a, first_a, count_a, ids_b, first_b, count_b, doc, links) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, A id, B id) in one number, and how many links each stands for."""
        few = links <= MANY_LINKS
        each = np.where(few[group_a], count_b[group_a], 0)
        a = np.repeat(np.arange(len(ids_a)), each)
        group = group_a[a]
        b = first_b[group] + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        keys, times = np.unique(doc[group] << 2 * ID_BITS | ids_a[a] << ID_BITS | ids_b[b], return_counts=True)
        if few.all():
            return keys, times
        all_keys, all_times = [keys], [times]
        for g in np.flatnonzero(~few):
            own_a, n_a = np.unique(ids_a[first_a[g]:first_a[g] + count_a[g]], return_counts=True)
            own_b, n_b = np.unique(ids_b[first_b[g]:first_b[g] + count_b[g]], return_counts=True)
            all_keys.append((doc[g] << 2 * ID_BITS | own_a[:, None] << ID_BITS | own_b[None, :]).ravel())
            all_times.append((n_a[:, None] * n_b[None, :]).ravel())
        keys, place = np.unique(np.concatenate(all_keys), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.concatenate(all_times))
        return keys, times

    def _texts(self, ids_a, group_a, ids_b, group_b, unit_a, unit_b, n) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit: the tokens in order of group and tokenizer, each with what follows it."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([ids_a, ids_b])[order], side[order]
        after = np.full(len(ids), ord(";"), np.uint8)
        step = np.diff(side)
        after[:-1][step == 0] = ord(",")
        after[:-1][(step == 1) & (side[:-1] % 2 == 0)] = ord("|")
        rows = np.concatenate([self.digits[ids], after[:, None]], axis=1)
        text = rows[rows != 0].tobytes().decode()
        per_unit = np.zeros(n + 1, np.int64)
        np.add.at(per_unit, np.concatenate([unit_a, unit_b])[order] + 1, self.n_digits[ids] + 1)
        at = np.cumsum(per_unit).tolist()
        return [text[i:j - 1] for i, j in zip(at[:-1], at[1:], strict=True)]


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in as many bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner, with the units it has seen in earlier tasks."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(Encoders(*paths))
    return _ALIGNERS[paths]


def encoded(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], block_pairs: int) -> DataFrame:
    """Blocks of documents with their pairs as places in a shared list (``pairs``, ``holders``), which the block's first
    row holds."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(tuple(paths)), TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, ids, parts, held
            pairs, times = (sum((p[x] for p in parts), []) for x in ("pairs", "times"))
            whole, place = np.unique(np.concatenate(pairs), return_inverse=True)
            ends = np.cumsum([len(p) for p in pairs])
            steps = [_narrow(np.diff(x, prepend=0)) for x in np.split(place, ends[:-1])]
            lists = [[x.astype("<i8").tobytes()] + [None] * (len(pairs) - 1) for x in (whole, np.bincount(place, minlength=len(whole)))]
            out = pa.RecordBatch.from_arrays(
                [pa.array([number] * len(pairs)), pa.chunked_array(ids).combine_chunks(),
                 *(pa.array(np.concatenate([p[x] for p in parts])) for x in FIGURES), pa.array(sum((p["digest"] for p in parts), [])),
                 pa.array([len(p) for p in pairs]), pa.array(steps, pa.binary()), pa.array([_narrow(t) for t in times], pa.binary()),
                 *(pa.array(x, pa.binary()) for x in lists)],
                names=["block", "row_id", *FIGURES, "groups_sha256", "n_pairs", "steps", "times", "pairs", "holders"])
            number, ids, parts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < TOGETHER:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                found = align(texts)
                ids.append(batch.column(0).slice(at, len(texts)))
                parts.append(found)
                held += sum(map(len, found["pairs"])) + len(texts)
                at += len(texts)
                if held >= block_pairs:
                    yield block()
        if parts:
            yield block()

    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    return rows.mapInArrow(run, f"block long, row_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, n_pairs long, steps binary, times binary, pairs binary, holders binary")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None,
          block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = written(encoded(docs, id_col, text_col, paths or tokenizer_paths(), block_pairs), "alignment-blocks")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(holders, "<i8")
                for at in range(0, len(pair), 1 << 16):
                    some = pair[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(n[at:at + (1 << 16)])],
                                                     names=["block", "pair", "n"])

    lists = rows.filter("pairs IS NOT NULL").select("block", "pairs", "holders").mapInArrow(listed, "block long, pair long, n long")
    lists = written(lists, "alignment-lists")
    counts = pair_counts(lists)
    told = lists.select("block", F.col("pair").alias("p")).join(counts.hint("merge"), F.col("p") == F.col("pair")).select(
        "block", "pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def looked_up(key: tuple, documents: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        weights = weights.sort_values("pair")
        n, best = weights["n"].to_numpy(np.int64), weights["best"].to_numpy(bool)
        n_best, count_sum = [], []
        for k, steps, times in zip(documents["n_pairs"], documents["steps"], documents["times"], strict=True):
            place, links = np.cumsum(_wide(steps, k)), _wide(times, k)
            n_best.append(int(links[best[place]].sum()))
            count_sum.append(int((links * n[place]).sum()))
        return pd.DataFrame({id_col: documents["row_id"], **{x: documents[x] for x in FIGURES}, "n_best": n_best, "count_sum": count_sum,
                             "groups_sha256": documents["groups_sha256"]})

    return rows.drop("pairs", "holders").groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        looked_up, f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, most): documents that hold each pair linked, and the largest such count of its A id."""
    counts = written(lists.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    by_a = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(by_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright(counts.pair, ID_BITS) == F.col("a")).select("pair", "n", "most")
