"""Operator 3, language identification: averaged hashed subword embeddings with a linear softmax.

A text becomes its UTF-8 bytes with A-Z lowered and all other ASCII characters but letters turned into spaces; its
features are the byte 3- and 4-grams inside words (a space may only stand first or last), hashed into
``BUCKETS`` rows of an embedding. The mean of the rows goes through a linear layer and a softmax. The model is
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents: ``SAMPLE_DOCS`` in all, or one a
language if there are more languages, dealt evenly among all languages, those with the smallest hashes of id and text.
Each gives its whole text and a fragment of a few words, so short texts are learned too. A fifth of the sample is set
aside to calibrate: a temperature by likelihood, and the rejection.

A text is rejected if its subwords are not those of the learned languages. Its familiarity is the mean, over its subwords, of
the log of how much more often than evenly their bucket is hit in learned texts, measured from the mean of known texts
and scaled by the root of the number of subwords (up to ``FULL``). The threshold lies halfway between what nearly all
held-back texts, fragments and mixtures of two languages reach and what held-back texts with their letters shuffled,
and texts of a language left out of the table, stay below; without such a gap it is what the known texts reach.

Prediction is one map over all documents with no shuffle; a long text is read in blocks, whole. Only text and
label of learning documents (``crc32(id) mod 3 <> 1``) are used; label, source and id are no input of a prediction.

Defined results: a null text or one without a letter gives ``und`` with score 0, not accepted; without any labelled
document everything is ``und``; equal texts get equal answers; rows with null labels are predicted but not
learned; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import id_remainder

BUCKETS, DIM = 1 << 14, 16
#: Every so many-th document of the sample is set aside to calibrate.
ASIDE = 5
SAMPLE_DOCS = 2400
EPOCHS, BATCH, RATE, SEED = 8, 32, 60.0, 7
#: Share of known texts that may fall below the threshold, and of foreign ones that may stand above, where they overlap.
REJECT_SHARE, FOREIGN_SHARE = 0.001, 0.02
#: Subwords from which a text is judged in full; weight of a bucket never hit, in hits on average.
FULL, UNSEEN = 400, 0.02
#: Bytes of a text looked at at once.
BLOCK = 1 << 20
UNKNOWN = "und"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[a-z]")


def has_letter(text: str, folded: bytes) -> bool:
    return bool(ASCII_LETTER.search(folded)) or (not text.isascii() and any(map(str.isalpha, text)))


def _grams(folded: bytes) -> np.ndarray:
    """Buckets of the 3- and 4-grams of folded bytes."""
    b = np.frombuffer(folded, np.uint8)
    if len(b) < 3:
        return np.empty(0, np.int64)
    wide, inner = b.astype(np.uint32), b != 32
    three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    out = [(three[inner[1:-1]] * np.uint32(2654435761)) >> np.uint32(18)]
    if len(b) > 3:
        four = (three[:-1] | wide[3:] << 24)[inner[1:-2] & inner[2:-1]]
        out.append((four * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(18))
    return np.concatenate(out)


def gram_counts(folded: bytes) -> np.ndarray:
    """Count of each bucket over the whole text, read in overlapping blocks."""
    padded = b" " + folded + b" "
    counts = np.bincount(_grams(padded[:BLOCK]), minlength=BUCKETS)
    for at in range(BLOCK - 3, len(padded) - 3, BLOCK - 3):
        block = padded[at:at + BLOCK]
        # the 3-gram and 4-gram that end inside the overlap were counted before
        counts += np.bincount(_grams(block), minlength=BUCKETS) - np.bincount(_grams(block[:3]), minlength=BUCKETS)
    return counts


def familiar(shares: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share of the learned subwords against an even one."""
    return np.log((shares * (BUCKETS / max(shares.sum(), 1e-300)) + UNSEEN) / (1 + UNSEEN))


def judged(counts: np.ndarray, table: np.ndarray, middle: float) -> float:
    """Familiarity of a text, from the middle of known texts, scaled by the text's length."""
    n = counts.sum()
    return float((counts @ table / n - middle) * min(n, FULL) ** 0.5) if n else -np.inf


class Model:
    """Per-bucket language scores (the product of both layers), bias, temperature, familiarity, its middle and threshold."""

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray):
        self.langs, self.scores, self.bias, self.temperature = langs, scores, bias, 1.0
        self.table, self.middle, self.threshold = np.zeros(BUCKETS), 0.0, -np.inf

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.scores / max(1, counts.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        folded = (text or "").encode().translate(FOLD)
        if not self.langs or not has_letter(text or "", folded):
            return UNKNOWN, 0.0, False
        counts = gram_counts(folded)
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), judged(counts, self.table, self.middle) >= self.threshold


def _fragment(text: str, seed: int) -> str:
    """Three to twelve words from somewhere in the text."""
    words = text.split()
    n = 3 + seed % 10
    at = (seed >> 4) % max(1, len(words) - n + 1)
    return " ".join(words[at:at + n])


def _shuffled(text: str, seed: int) -> str:
    """The text's letters in random order, its words as long as before."""
    at = [i for i, c in enumerate(text) if c.isalpha()]
    out = list(text)
    for i, j in zip(at, np.random.default_rng(seed).permutation(at).tolist(), strict=True):
        out[i] = text[j]
    return "".join(out)


def _examples(sample: DataFrame) -> DataFrame:
    """Sparse features of the sampled documents (part 0), of one fragment of each (1) and, of those set aside, of the text with
    its letters shuffled (2), counted on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed = zlib.crc32(str(doc).encode())
                parts = (text or "", _fragment(text or "", seed), _shuffled(text or "", seed) if seed % ASIDE == 0 else "")
                for part, t in enumerate(parts):
                    folded = t.encode().translate(FOLD)
                    if has_letter(t, folded):
                        counts = gram_counts(folded)
                        at = np.flatnonzero(counts)
                        rows.append((lang, seed, part, at.astype("<i4").tobytes(), counts[at].astype("<i4").tobytes()))
            if rows:
                types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=["lang", "seed", "part", "at", "n"])
    return sample.mapInArrow(run, "lang string, seed long, part int, at binary, n binary")


def _dense(examples: list) -> np.ndarray:
    x = np.zeros((len(examples), BUCKETS), np.float32)
    for row, (at, n, _) in zip(x, examples, strict=True):
        row[at] = n / n.sum()
    return x


def fit(examples: list[tuple[str, int, int, bytes, bytes]]) -> Model:
    """Train, then calibrate, on (lang, seed, part, buckets, counts)."""
    langs = sorted({e[0] for e in examples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    data = [((np.frombuffer(a, "<i4"), np.frombuffer(n, "<i4"), langs.index(lang)), seed % ASIDE == 0, part)
            for lang, seed, part, a, n in sorted(examples, key=lambda e: (e[1], e[2], e[0], e[3]))]
    known = [(d, aside, part) for d, aside, part in data if part < 2]
    train = [d for d, aside, _ in known if not aside] or [d for d, *_ in known]
    whole = [d for d, aside, part in known if not aside and part == 0] or [d for d, _, part in known if part == 0] or train
    held = [(d, part) for d, aside, part in known if aside]
    shuffled = [d for d, _, part in data if part == 2]
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = EPOCHS * -(-len(train) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for i in range(0, len(order), BATCH):
            rows = [train[k] for k in order[i:i + BATCH]]
            x = _dense(rows)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), [r[2] for r in rows]] -= 1
            p /= len(rows)
            rate = RATE * (1 - step / steps)
            grad_h = p @ out.T
            out -= min(rate, 2.0) * (h.T @ p)
            bias -= min(rate, 2.0) * 0.05 * p.sum(0)
            emb -= rate * (x.T @ grad_h)
            step += 1
    model = Model(langs, (emb @ out).astype(np.float64), bias.astype(np.float64))
    calibrate(model, whole, held or [(d, 0) for d in train], shuffled)
    held = [d for d, _ in held] or train
    logits = np.array([model.logits(np.bincount(at, n, BUCKETS)) for at, n, _ in held])
    truth = np.array([y for *_, y in held])

    def chances(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.02, 5.0, 60)
    nll = [-np.log(np.maximum(chances(t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(nll))])
    return model


def calibrate(model: Model, whole: list, held: list, shuffled: list) -> None:
    """Set what makes a text familiar: the table from learned texts, the middle and the threshold from held-back ones."""
    shares = np.zeros((len(model.langs), BUCKETS))
    for at, n, lang in whole:
        shares[lang, at] += n / n.sum()

    def dense(example) -> np.ndarray:
        return np.bincount(example[0], example[1], BUCKETS)

    model.table = familiar(shares.sum(axis=0))
    texts = [d for d, part in held if part == 0] or [d for d, _ in held]
    model.middle = float(np.mean([dense(d) @ model.table / d[1].sum() for d in texts]))
    known = [judged(dense(d), model.table, model.middle) for d, _ in held]
    # neighbours in the (hashed) order that speak two languages
    known += [judged(dense(a) + dense(b), model.table, model.middle) for a, b in zip(texts, texts[1:], strict=False) if a[2] != b[2]]
    foreign = [judged(dense(d), model.table, model.middle) for d in shuffled]
    for lang in range(len(model.langs) if len(model.langs) > 1 else 0):
        others = [d for d in texts if d[2] != lang]
        if not others:
            continue
        table = familiar(np.delete(shares, lang, axis=0).sum(axis=0))
        middle = float(np.mean([dense(d) @ table / d[1].sum() for d in others]))
        foreign += [judged(dense(d), table, middle) for d in texts if d[2] == lang and d[1].sum() >= FULL]
    low = float(np.quantile(known, REJECT_SHARE))
    high = float(np.quantile(foreign, 1 - FOREIGN_SHARE)) if foreign else low
    model.threshold = (low + high) / 2 if high < low else low


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of the learning documents; only its sparse features reach the driver."""
    learn = docs.filter(F.col(lang_col).isNotNull() & (id_remainder(id_col, 3) != 1))
    learn = learn.select(F.col(id_col).cast("string").alias("doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc", "text"), 1)
    learn = learn.withColumn("place", place)
    found = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()  # one row a language
    if not found:
        return fit([])
    each = max(1, sample_docs // len(found))
    # about twice as many as wanted, and the first of each language in any case; equal rows count once
    bounds = F.create_map(*(F.lit(x) for row in found for x in (row["lang"], int(max(row["first"], min(1.0, 2 * each / row["n"]) * (2 ** 63 - 1024))))))
    drawn = learn.filter(F.col("place") <= bounds[F.col("lang")]).dropDuplicates(["lang", "place"])
    order = Window.partitionBy("lang").orderBy("place")
    sample = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("doc", "lang", "text")
    columns = _examples(sample).toArrow().to_pydict()
    return fit(list(zip(*columns.values(), strict=True)))


def predictions(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and accepted added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            added = [pa.array([s[k] for s in said], kind) for k, kind in enumerate(kinds)]
            keep = [i for i, name in enumerate(batch.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added],
                                             names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score", "accepted"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != text_col] + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: held_out, lang_pred, score (calibrated chance of the answer) and accepted."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("row_id"), (id_remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("row_text"))
    return predictions(rows, "row_text", model).withColumnRenamed("row_id", id_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns unchanged."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct("*").alias("row_all"), F.col(text_col).alias("row_text"))
    return predictions(rows, "row_text", model).filter("accepted").select("row_all.*")
