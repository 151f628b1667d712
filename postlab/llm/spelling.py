"""Operator 12, spelling variants of the corpus's words by a relational trie frontier.

Runs of ASCII and Latin-1 letters are words (A-Z lowered); where 31 divides the crc32 of ``<id>:<run>`` the run loses the code
point at that hash modulo its length. Words of at least ``MIN_LENGTH`` code points seen at least ``MIN_COUNT`` times are
compared: two are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word
of largest count (ties: the smallest), if that is at least ``TIMES`` times its own; its root is the end of the forms.

The trie is a table of edges, keyed by a hash of node and character, for the words read forwards and backwards and
for each word length. A state is (word, position, node, edits). It begins at the middle of its word, where the trie is
sparse: an edit in the second half of a word is met forwards, one in the first half backwards, none twice.

1. The states without an edit stand on their own word's nodes, so they need no join. At each position a state spends its
   edit: it skips a character of the word (a deletion, in the trie of words one shorter) or takes an edge of another
   character (a replacement, by an edge over two levels, so the next character must fit too).
2. Level by level the states with one edit are joined with the edges of the next character. One that reaches a node with a
   single word below it ends as a candidate pair; the others go on, a level deeper each round.
3. Candidates are verified by their words. An insertion is a deletion seen from the other word.

Equal texts and words collapse before: words are counted by task, then summed. All joins are by 64-bit keys that spread
evenly, as a key holds a prefix of half a word. A word has no more near words than characters times places. Words longer
than ``LONG`` would need as many rounds: they meet by one join on what is left of each word without one place.

Defined results: null and empty texts have no words; a null id hashes like an empty one; repeated rows count each; no word
seen often enough, or an empty table, gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import written

MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
DROP = 31
LONG = 40
#: Distinct words a task holds before it hands them on.
HELD_WORDS = 200_000
RUN = re.compile("[a-zÀ-ÿ]+")
#: Kinds of edges: one level, two levels, to the children that are words, to the node itself if it is a word.
STEP, SKIP, LAST, SELF = 1, 2, 3, 4


def words_of(doc: str, text: str | None, shortest: int) -> Counter:
    """Counts of a text's words."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
        if len(run) >= shortest:
            h = zlib.crc32(run.encode(), start)
            if h % DROP == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                out[run] += n
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, shortest: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words seen often enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                held.update(words_of(doc.as_py(), text.as_py(), shortest))
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least)


def _char(t: Column, at: Column) -> Column:
    """Code point at a place, from 0."""
    return F.ascii(F.substring(t, at + 1, F.lit(1)))


def _node(length: Column, depth: Column) -> Column:
    """A prefix in the trie of words of one length and direction."""
    return F.xxhash64(F.col("back"), length, F.substring(F.col("t"), F.lit(1), depth))


def _read(word: Column, back: Column) -> Column:
    return F.when(back, F.reverse(word)).otherwise(word)


def _sided(words: DataFrame) -> DataFrame:
    """Each word forwards and backwards, with the depth from which its edits are sought."""
    size = F.length("word")
    both = words.select("word", size.alias("size"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.shiftright("size", 1)
    return both.withColumn("t", _read(F.col("word"), F.col("back"))).withColumn("begin", F.when(F.col("back"), F.col("size") - half).otherwise(half))


def nodes(words: DataFrame) -> DataFrame:
    """(node, up, up2, c, c2, is_word, below, one): nodes of the tries beyond the middle, their last characters, and how many
    words lie below, one of them by its hash."""
    every = _sided(words).select("*", F.explode(F.sequence(F.col("begin") + 1, "size")).alias("depth"))
    depth, size, t = F.col("depth"), F.col("size"), F.col("t")
    every = every.select(_node(size, depth).alias("node"), _node(size, depth - 1).alias("up"), _node(size, depth - 2).alias("up2"),
                         _char(t, depth - 1).alias("c"), _char(t, depth - 2).alias("c2"), (depth == size).alias("is_word"),
                         F.xxhash64("word").alias("id"))
    return every.groupBy("node", "up", "up2", "c", "c2", "is_word").agg(F.count(F.lit(1)).alias("below"), F.min("id").alias("one"))


def edges(found: DataFrame) -> DataFrame:
    """(key, other, to, ends): where a state arrives, a node or, with ``ends``, the only word below it; ``other`` is the
    character that a replacement puts in."""
    def edge(key: Column, other: Column) -> Column:
        return F.struct(key.alias("key"), other.cast("int").alias("other"))

    none = F.lit(None)
    all_nodes = F.array(edge(F.xxhash64("up", F.lit(STEP), "c"), none), edge(F.xxhash64("up2", F.lit(SKIP), "c"), F.col("c2")))
    ends = F.array(edge(F.xxhash64("up", F.lit(LAST)), F.col("c")), edge(F.xxhash64("node", F.lit(SELF)), none))
    arrivals = F.when(F.col("is_word"), F.concat(all_nodes, ends)).otherwise(all_nodes)
    return found.select(F.explode(arrivals).alias("e"), *_arrival()).select("e.*", "to", "ends")


def _arrival() -> list[Column]:
    ends = F.col("below") == 1
    return [F.when(ends, F.col("one")).otherwise(F.col("node")).alias("to"), ends.alias("ends")]


def first_edits(words: DataFrame) -> DataFrame:
    """(word, back, place, key, own): each state that spends its edit, the place it reads next, and the character it must not take."""
    at = _sided(words).select("*", F.explode(F.sequence("begin", F.col("size") - 1)).alias("at"))
    place, size, t = F.col("at"), F.col("size"), F.col("t")
    is_last, here, after = place == size - 1, _char(t, place), _char(t, place + 1)
    replaced = F.when(is_last, F.xxhash64(_node(size, place), F.lit(LAST))).otherwise(F.xxhash64(_node(size, place), F.lit(SKIP), after))
    deleted = F.when(is_last, F.xxhash64(_node(size - 1, place), F.lit(SELF))).otherwise(F.xxhash64(_node(size - 1, place), F.lit(STEP), after))
    deleted = F.when(is_last | (here != after), deleted)  # of equal neighbours the last one goes
    both = F.array(F.struct(replaced.alias("key"), here.alias("own")), F.struct(deleted.alias("key"), F.lit(-1).alias("own")))
    return at.select("word", "back", (place + 2).alias("place"), F.explode(both).alias("s")).select(
        "word", "back", "place", "s.key", "s.own").filter("key IS NOT NULL")


def candidates(words: DataFrame) -> DataFrame:
    """(word, one): pairs that the frontier ends with, the second word by its hash."""
    found = written(nodes(words), "spelling-nodes")
    states, all_edges, ended = first_edits(words), edges(found), None
    # from the second level on, states stand on nodes with several words below
    inner = found.filter("below > 1").select(F.col("node").alias("inner"))
    deeper = found.join(inner, F.col("up") == F.col("inner"), "left_semi").select(
        F.xxhash64("up", F.lit(STEP), "c").alias("key"), F.lit(None).cast("int").alias("other"), *_arrival())
    for level in range(LONG + 2):
        moved = states.join(all_edges, "key").filter("other IS NULL OR other <> own").select("word", "back", "place", "to", "ends")
        moved = written(moved, "spelling-states")
        done = moved.filter("ends").select("word", F.col("to").alias("one"))
        ended = done if ended is None else ended.unionByName(done)
        states = moved.filter("NOT ends")
        if states.isEmpty():
            return ended
        if level == 0:
            all_edges = written(deeper, "spelling-edges")
        t = _read(F.col("word"), F.col("back"))
        states = states.select("word", "back", (F.col("place") + 1).alias("place"), F.xxhash64("to", F.lit(STEP), _char(t, F.col("place"))).alias("key"),
                               F.lit(-1).alias("own"))
    raise RuntimeError("the frontier did not end")


def long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of words of which one is longer than ``LONG``: those that are equal without one place."""
    word, size = F.col("word"), F.length("word")
    every = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    rest = F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.col("size")))
    cut = every.select("word", "size", "at", F.xxhash64(rest).alias("rest"))
    other = cut.select(F.col("word").alias("near"), F.col("size").alias("size2"), F.col("at").alias("at2"), F.col("rest").alias("rest2"))
    replaced = cut.join(other, (F.col("rest") == F.col("rest2")) & (F.col("at") == F.col("at2")) & (F.col("size") == F.col("size2"))).filter("word <> near")
    shorter = words.select(F.col("word").alias("near"), F.xxhash64("word").alias("whole"))
    deleted = cut.join(shorter, F.col("rest") == F.col("whole")).filter(F.length("near") == F.col("size") - 1)
    return replaced.filter(F.col("size") > LONG).select("word", "near").unionByName(deleted.filter(F.col("size") > LONG).select("word", "near"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of all words one edit apart."""
    ids = words.select(F.xxhash64("word").alias("id"), F.col("word").alias("near"))
    found = candidates(words.filter(F.length("word") <= LONG))
    found = found.join(ids, F.col("one") == F.col("id")).select("word", "near")
    found = found.unionByName(long_pairs(words.filter(F.length("word") >= LONG)))
    found = found.filter(F.levenshtein("word", "near", 1) == 1)
    ordered = found.select(F.least("word", "near").alias("a"), F.greatest("word", "near").alias("b")).distinct()
    pairs = written(ordered, "spelling-pairs")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))


def followed(forms: DataFrame) -> DataFrame:
    """(child, root) from (child, root): the end of each chain of forms; chains halve every round."""
    forms = written(forms, "spelling-forms")
    for _ in range(40):  # a form's count is several times its word's, so chains are short
        up = forms.select(F.col("child").alias("mid"), F.col("root").alias("above"))
        forms = written(forms.join(up, F.col("root") == F.col("mid"), "left").select(
            "child", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        if forms.filter("moved").isEmpty():
            return forms.select("child", "root")
        forms = forms.select("child", "root")
    raise RuntimeError("forms did not end")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_LENGTH, least: int = MIN_COUNT,
             times: int = TIMES) -> DataFrame:
    """One row per word: form, root, n, n_near, form_n."""
    words = written(counted(docs, id_col, text_col, shortest, least), "spelling-words")
    pairs = near_pairs(words)
    counts = words.select(F.col("word").alias("known"), F.col("n").alias("near_n"))
    best = pairs.join(counts, F.col("near") == F.col("known")).groupBy(F.col("word").alias("own")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, F.col("word") == F.col("own"), "left")
    has_form = -F.col("best.less") >= times * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
                       F.when(has_form, -F.col("best.less")).alias("form_n"))
    told = written(told, "spelling-told")
    roots = followed(told.filter("form IS NOT NULL").select(F.col("word").alias("child"), F.col("form").alias("root")))
    return told.join(roots, F.col("word") == F.col("child"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
