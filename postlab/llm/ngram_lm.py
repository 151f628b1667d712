"""Operator 7, language-model scoring with an Elias-Fano n-gram trie.

Words are maximal runs without ASCII white space, A-Z lowered; an end mark closes each text and is also the first
word's context. Level 1 of the trie is the vocabulary: sorted 64-bit word hashes as Elias-Fano sequences with exact
counts; a word's id is its rank. Level 2 holds every bigram, its context the id of the word before; level 3 every
trigram, its context the id (rank) of the bigram before. Both keep sorted contexts, monotone pointers to their ranges,
and successors made monotone by adding the last value of the range before, so a successor is found by one search
relative to its context. An n-gram stores its discounted probability and a context its back-off weight, both quantised: one
byte each, a bin of the logarithm in the shard's book. The bigram level also keeps exact counts, from which the trigram
level's contexts are dealt. All levels are cut into shards, written as files into the shared folder and memory-mapped.

    p(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | u)   = a(u w) + b(u) p(w),           a(u w) = (c(u w) - D) / c(u),          b(u) = D k(u) / c(u)
    p(w | t u) = a(t u w) + b(t u) p(w | u),   a(t u w) = (c(t u w) - D) / c(t u),    b(t u) = D k(t u) / c(t u)

a and b are what is stored; a is 0 for n-grams not in the trie, k is the number of different successors, and an unseen
context leaves the shorter one. The base score uses exact counts. A text's first word has the end
mark alone as its context, the second the end mark and the first word.

Counting is by Spark: tasks count what they read and send the keys of each shard in one piece; the task that builds a
shard sums them, so no n-gram is left out and each is shuffled once a batch. A context's successors share a shard,
except that one seen often is dealt over several by its successors; k of those is summed in one small file.
Scoring is one map over all texts.

Defined results: a null or empty text is the end mark alone; repeated rows are counted and scored one by one;
without training documents N = V = 0 and every base probability is 1 (score 0); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import id_remainder, shared_path, written
from postlab.llm.eliasfano import U64, EliasFano, mapped, quantised, save

DISCOUNT = 0.5
ADD = 0.1
SHARD_ROWS = 1 << 20
#: A context seen more often than a shard's rows divided by this is dealt over several shards.
CONTEXT_PARTS = 8
#: Words looked at together while counting and while scoring.
COUNT_WORDS, SCORE_WORDS = 1_000_000, 1_000_000
#: Texts hashed together start within so many bytes.
PIECE_BYTES = 1 << 21
#: Word hashes: the sum of a number for each byte (equal for A-Z and a-z) times the factor to the power of its place.
FACTOR = 0xD1342543DE82EF95
HASH_BYTES = 1 << 18
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE_NUMBERS = np.random.default_rng(7).integers(0, 1 << 63, 256, U64) * U64(2) + U64(1)
BYTE_NUMBERS[ord("A"):ord("Z") + 1] = BYTE_NUMBERS[ord("a"):ord("z") + 1]
POWERS, INVERSES = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(HASH_BYTES - 1, f, U64)])) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
NO_ID = -1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[begin:end], by blocks of bytes; a word longer than a block is summed piece by piece."""
    out, at = np.empty(len(begins), U64), 0
    while at < len(begins):
        first = begins[at]
        to = int(np.searchsorted(ends, first + HASH_BYTES - 1, side="right"))
        if to == at:
            total = 0
            for k in range(first, ends[at], HASH_BYTES):
                numbers = BYTE_NUMBERS[data[k:min(k + HASH_BYTES, ends[at])]]
                total += int((numbers * POWERS[:len(numbers)]).sum(dtype=U64)) * pow(FACTOR, int(k - first), 1 << 64)
            out[at], to = total % (1 << 64), at + 1
        else:
            numbers = BYTE_NUMBERS[data[first:ends[to - 1]]]
            numbers *= POWERS[:len(numbers)]
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(numbers)])
            begin = begins[at:to] - first
            out[at:to] = (sums[ends[at:to] - first] - sums[begin]) * INVERSES[begin]
        at = to
    return mixed(out)


#: The end mark: the hash of what no word holds.
END = int(word_hashes(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0])


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each text closed by the end mark, and how many each text has."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    word = ~SPACE[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begins, bounds))
    out = np.full(len(begins) + len(texts), END, U64)
    out[np.arange(len(begins)) + np.repeat(np.arange(len(texts)), counts)] = word_hashes(data, begins, ends)
    return out, counts + 1


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``PIECE_BYTES`` of text each; a longer text ends its run."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECE_BYTES, prepend=-1))
    for begin, end in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=False):
        yield batch.slice(begin, end - begin)


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches together until they hold ``most`` words: (batches, all hashes, first place of each text)."""
    held, parts, sizes, words = [], [], [], 0

    def together():
        return held, np.concatenate(parts), np.cumsum(np.concatenate([[0], *sizes]))[:-1]

    for batch in (piece for whole in batches for piece in _pieces(whole, column)):
        hashes, lengths = hashed(batch.column(column))
        held.append(batch), parts.append(hashes), sizes.append(lengths)
        words += len(hashes)
        if words >= most:
            yield together()
            held, parts, sizes, words = [], [], [], 0
    if held:
        yield together()


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shards that have rows, and the places of each in order."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    numbers, first = np.unique(shard[order], return_index=True)
    return numbers, np.split(order, first[1:]) if len(numbers) else []


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as differences, equal bytes of all of them side by side, so that compression finds their zeros."""
    return np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def shard_base(shard: int, shards: int) -> int:
    """The smallest hash of a shard."""
    return -(-(shard << 32) // shards) << 32


def coded(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Values as places in the sorted book of all that occur, as narrow as their number allows."""
    book, codes = np.unique(values, return_inverse=True)
    return {f"{name}.book": book.astype(np.int64), f"{name}.codes": codes.astype(np.min_scalar_type(len(book)))}


def chances(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Positive numbers, quantised by their logarithms."""
    codes, book = quantised(np.log10(values))
    return {f"{name}.book": (10.0 ** book.astype(np.float64)), f"{name}.codes": codes}


def _nothing(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.full(n, NO_ID, np.int64), np.zeros(n, np.int64), np.zeros(n), np.ones(n)


class Trie:
    """What a task needs to read the levels: folder, first id of each shard of each level (and the end), totals."""

    def __init__(self, folder: str, n: int, v: int, shard_rows: int = SHARD_ROWS):
        self.folder, self.n, self.v = folder, n, v
        self.part, self.bits = max(1, shard_rows // CONTEXT_PARTS), int(v + 1).bit_length()
        self.firsts: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "open"}

    def _file(self, name: str) -> dict:
        cache = self.__dict__.setdefault("open", {})
        if name not in cache:
            arrays = mapped(f"{self.folder}/{name}")
            cache[name] = dict(arrays) | {x[:-5]: EliasFano.of(arrays, x[:-5]) for x in arrays if x.endswith(".head")}
        return cache[name]

    def _by_shard(self, level: str, shard: np.ndarray) -> Iterator[tuple[int, dict, np.ndarray]]:
        """(first id, arrays, places) of each shard that has rows."""
        numbers, places = by_shard(shard)
        for number, at in zip(numbers.tolist(), places, strict=True):
            if self.firsts[level][number + 1] > self.firsts[level][number]:
                yield int(self.firsts[level][number]), self._file(f"{level}-{number:06d}"), at

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.n + ADD * (self.v + 1))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (NO_ID if unknown) and counts of word hashes."""
        ids, counts = np.full(len(hashes), NO_ID, np.int64), np.zeros(len(hashes), np.int64)
        if not self.v:
            return ids, counts
        shards = len(self.firsts["vocabulary"]) - 1
        shard = shard_of(hashes, shards)
        for first, level, at in self._by_shard("vocabulary", shard):
            place, hit = level["hashes"].successor(hashes[at] - U64(shard_base(int(shard[at[0]]), shards)))
            ids[at[hit]] = place[hit] + first
            counts[at[hit]] = level["counts"][place[hit]]
        return ids, counts

    def dealt(self, context: np.ndarray, word: np.ndarray, seen: np.ndarray, shards: int) -> np.ndarray:
        """Shard of each pair of context and word; ``seen`` is the context's count."""
        return shard_of(mixed(context.astype(U64) + mixed(mixed(word) % (seen // self.part + 1).astype(U64))), shards)

    def find(self, level: str, context: np.ndarray, word: np.ndarray, seen: np.ndarray, which: slice = slice(0, 4)) -> tuple[np.ndarray, ...]:
        """Ids (NO_ID if not in the trie), counts (bigrams only) and discounted probabilities (0 if not in the trie) of
        n-grams, and the back-off weights of their contexts (1 if unseen); ``which`` of these four."""
        out = _nothing(len(word))[which]
        known = np.flatnonzero(seen)
        if level not in self.firsts or not len(known):
            return out
        _, some, place = np.unique(context[known] << self.bits | (word[known] + 1), return_index=True, return_inverse=True)
        some = known[some]
        found = self._find(level, context[some], word[some], seen[some])[which]
        for whole, x in zip(out, found, strict=True):
            whole[known] = x[place]
        return out

    def _find(self, level: str, context: np.ndarray, word: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, counts, own, weight = _nothing(len(word))
        for first, arrays, at in self._by_shard(level, self.dealt(context, word, seen, len(self.firsts[level]) - 1)):
            # queries come sorted, so each context is looked up once
            new = np.concatenate([[True], context[at[1:]] != context[at[:-1]]])
            k, hit = arrays["contexts"].successor(context[at[new]].astype(U64))
            of = np.cumsum(new) - 1
            at, of = at[hit[of]], (np.cumsum(hit) - 1)[of[hit[of]]]
            k = k[hit]
            weight[at] = arrays["weights.book"][arrays["weights.codes"][k]][of]
            bounds = arrays["pointers"].access(np.concatenate([k, k + 1])).astype(np.int64)
            begin, end = bounds[:len(k)], bounds[len(k):]
            base = np.where(begin > 0, arrays["words"].access(np.maximum(begin - 1, 0)), U64(0))
            place, hit = arrays["words"].successor(base[of] + (word[at] + 1).astype(U64))
            hit &= (place < end[of]) & (word[at] != NO_ID)
            ids[at[hit]] = place[hit] + first
            own[at[hit]] = arrays["own.book"][arrays["own.codes"][place[hit]]]
            if "counts.codes" in arrays:
                counts[at[hit]] = arrays["counts.book"][arrays["counts.codes"][place[hit]]]
        often = np.flatnonzero(seen >= self.part)
        if len(often):
            arrays = self._file(f"{level}-often")
            weight[often] = arrays["weights"][np.searchsorted(arrays["contexts"], context[often])]
        return ids, counts, own, weight


def _counted(docs: DataFrame, keys_of, name: str) -> DataFrame:
    """(key, n): ``keys_of(hashes, starts)`` counted by task, then summed by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, starts in _texts(batches, 0, COUNT_WORDS):
            keys, n = np.unique(keys_of(hashes, starts), return_counts=True)
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 18)].view(np.int64)), pa.array(n[at:at + (1 << 18)])], names=["key", "n"])

    return written(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), name)


def _shifted(values: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """What stands one word before, ``first`` at the first word of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def _bigrams(trie: Trie, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: context id, word id, context's count and word's count."""
    unique, place = np.unique(hashes, return_inverse=True)
    ids, counts = trie.words(unique)
    word, count = ids[place], counts[place]
    end = int(np.searchsorted(unique, U64(END)))
    return _shifted(word, starts, ids[end]), word, _shifted(count, starts, counts[end]), count


def _trigrams(trie: Trie, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: id of the bigram before, word id, count of the bigram before (0 at the first word of a text)."""
    context, word, seen, _ = _bigrams(trie, hashes, starts)
    ids, counts = trie.find("bigram", context, word, seen, slice(0, 2))
    return _shifted(ids, starts, NO_ID), word, _shifted(counts, starts, 0)


def _often(contexts: np.ndarray, seen: np.ndarray, part: int) -> bytes:
    """The contexts seen so often that their successors are dealt over several shards, and their counts."""
    often = seen >= part
    return np.unique(np.column_stack([contexts[often], seen[often]]), axis=0).astype(np.int64).tobytes()


def _add_level(docs: DataFrame, trie: Trie, level: str, grams_of, shard_rows: int) -> None:
    """Count the n-grams (context, word, context's count) that ``grams_of`` gives and write them as a level."""
    shards = -(-trie.n // shard_rows)  # at most one key a word
    bits, folder = trie.bits, trie.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, starts in _texts(batches, 0, COUNT_WORDS):
            context, word, seen, *_ = grams_of(hashes, starts)
            known = np.flatnonzero(seen)
            keys, some, n = np.unique(context[known] << bits | word[known], return_index=True, return_counts=True)
            seen = seen[known[some]]
            shard = trie.dealt(keys >> bits, keys & ((1 << bits) - 1), seen, shards)
            numbers, pieces = by_shard(shard)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers, pa.int64()), pa.array([packed(keys[at]) for at in pieces], pa.binary()),
                pa.array([n[at].astype(np.int32).tobytes() for at in pieces], pa.binary()),
                pa.array([_often(keys[at] >> bits, seen[at], trie.part) for at in pieces], pa.binary())],
                names=["shard", "keys", "n", "often"])

    def shard_file(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        all_keys = np.concatenate([unpacked(raw) for raw in pdf["keys"]])
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
        n = np.add.reduceat(np.frombuffer(b"".join(pdf["n"]), np.int32)[order].astype(np.int64), first)
        u, w = all_keys[first] >> bits, all_keys[first] & ((1 << bits) - 1)
        new = np.concatenate([[True], u[1:] != u[:-1]])
        first = np.flatnonzero(new)
        pointers = np.append(first, len(u))
        base = np.concatenate([[0], np.cumsum(w[pointers[1:] - 1] + 1)[:-1]])  # the last value of the range before
        words = (w + 1 + base[np.cumsum(new) - 1]).astype(U64)
        kinds = np.diff(pointers)
        # a context's count is the sum over its successors, unless they are dealt over several shards
        total = np.add.reduceat(n, first)
        often = np.unique(np.frombuffer(b"".join(pdf["often"]), np.int64).reshape(-1, 2), axis=0)
        place = np.searchsorted(u[first], often[:, 0])
        total[place] = often[:, 1]
        save(f"{folder}/{level}-{int(key[0]):06d}", EliasFano.build(u[first].astype(U64)).parts("contexts")
             | EliasFano.build(pointers.astype(U64)).parts("pointers") | EliasFano.build(words).parts("words")
             | chances((n - DISCOUNT) / np.repeat(total, kinds), "own") | chances(DISCOUNT * kinds / total, "weights")
             | (coded(n, "counts") if level == "bigram" else {}))
        return pd.DataFrame({"shard": key[0], "context": [NO_ID, *often[:, 0].tolist()], "rows": [len(u), *kinds[place].tolist()],
                             "seen": [0, *often[:, 1].tolist()]})

    made = docs.mapInArrow(run, "shard long, keys binary, n binary, often binary").groupBy("shard").applyInPandas(
        shard_file, "shard long, context long, rows long, seen long").toPandas()  # one row per file, and CONTEXT_PARTS at most
    if made.empty:
        return
    whole = made["context"] == NO_ID
    sizes = np.zeros(shards, np.int64)
    sizes[made["shard"][whole]] = made["rows"][whole]
    often = made[~whole].groupby("context").agg({"rows": "sum", "seen": "first"})
    save(f"{folder}/{level}-often", {"contexts": often.index.to_numpy(np.int64),
                                     "weights": DISCOUNT * often["rows"].to_numpy(np.float64) / often["seen"].to_numpy(np.float64)})
    trie.firsts[level] = np.concatenate([[0], np.cumsum(sizes)])
    if int(trie.firsts[level][-1]).bit_length() + bits > 63:
        raise ValueError("n-gram and word id share 63 bits")


def train(docs: DataFrame, text_col: str, shard_rows: int = SHARD_ROWS, folder: str | None = None) -> Trie:
    """Count, smooth and write the trie over all given documents."""
    docs = docs.select(F.col(text_col).cast("binary").alias("t"))
    folder = folder or shared_path(docs.sparkSession, "ngram-trie")
    vocabulary = _counted(docs, lambda hashes, starts: hashes, "lm-words")
    v, n = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not v:
        return Trie(folder, 0, 0)
    if v >= 1 << 32:
        raise ValueError("word ids of a pair share 64 bits: at most 2**32 words")
    shards = -(-v // shard_rows)

    def vocabulary_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        hashes = pdf["key"].to_numpy().view(U64)
        order = np.argsort(hashes)
        sequence = EliasFano.build(hashes[order] - U64(shard_base(number, shards)))
        size = save(f"{folder}/vocabulary-{number:06d}", sequence.parts("hashes") | {"counts": pdf["n"].to_numpy()[order]})
        return pd.DataFrame({"shard": [number], "rows": [len(pdf)], "bytes": [size]})

    number = F.shiftright(F.shiftrightunsigned("key", 32) * shards, 32)
    sizes = {r["shard"]: r["rows"] for r in vocabulary.groupBy(number.alias("shard")).applyInPandas(
        vocabulary_shard, "shard long, rows long, bytes long").collect()}  # one row per file
    trie = Trie(folder, int(n), int(v), shard_rows)
    trie.firsts["vocabulary"] = np.cumsum([0] + [sizes.get(k, 0) for k in range(shards)])
    _add_level(docs, trie, "bigram", lambda hashes, starts: _bigrams(trie, hashes, starts), shard_rows)
    _add_level(docs, trie, "trigram", lambda hashes, starts: _trigrams(trie, hashes, starts), shard_rows)
    return trie


def scored(docs: DataFrame, id_col: str, text_col: str, trie: Trie) -> DataFrame:
    """One row per document: n_tokens, n_known, base_score and score under the trie."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, hashes, starts in _texts(batches, 1, SCORE_WORDS):
            context, word, seen, count = _bigrams(trie, hashes, starts)
            p = trie.probability(count) if trie.v else np.ones(len(count))
            alone = np.log10(p)
            ids, n, own, weight = trie.find("bigram", context, word, seen)
            p = own + weight * p
            own, weight = trie.find("trigram", _shifted(ids, starts, NO_ID), word, _shifted(n, starts, 0), slice(2, 4))
            p = own + weight * p
            together = np.log10(p)
            ends = np.append(starts[1:], len(hashes))
            columns = [pa.array(ends - starts), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                       pa.array(np.add.reduceat(alone, starts)), pa.array(np.add.reduceat(together, starts))]
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), *(c.slice(at, b.num_rows) for c in columns)],
                                                 names=[id_col, "n_tokens", "n_known", "base_score", "score"])
                at += b.num_rows

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("lm_text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents whose ``crc32(id) mod 10`` is not 0 and score all of them."""
    trie = train(docs.filter(id_remainder(id_col, 10) != 0), text_col)
    out = scored(docs, id_col, text_col, trie)
    return out.select(id_col, (id_remainder(id_col, 10) == 0).alias("held_out"), "n_tokens", "n_known",
                      F.lit(trie.n).cast("bigint").alias("train_tokens"), "base_score", "score")
