"""Chat formatting, WARC bundles, mixing, language model."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import crc, empty_like, odd_docs
from pyspark.sql import functions as F

from postlab.llm import chat, mixing, ngram_lm, warc
from postlab.llm.catalog import QUERIES
from postlab.llm.common import shared_path, table
from postlab.llm.eliasfano import U64, EliasFano, quantised

SF = "/root/testdata/sf0.01"
CHAT = "conv_id long, turn long, role string, text string, part string, loss string"


def test_chat_round_trip_of_awkward_texts(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", chat.PLANTED), (1, 1, "assistant", chat.PLANTED), (1, 2, "assistant", "<\\| <\\\\| \\n <|"),
             (2, 0, None, None), (2, 1, "assistant", ""), (2, 2, "assistant", "é\U0001f600<"), (3, None, "a\nb\\n<|", "x\ny"),
             (None, 0, "assistant", "z"), (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*t, "p", "l") for t in turns], CHAT)
    for part_bytes in (chat.PART_BYTES, 1):
        out = chat.format_chats(df, part_bytes=part_bytes).collect()
        by: dict = {}
        for r in sorted(out, key=lambda r: (str(r.conv_id), r.part)):
            assert len(chat.parse(r.formatted)) == r.n_turns
            by.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        for conv in (1, 2, 3, 4, None):
            want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == conv), key=key)]
            assert by[conv] == want
        got = {r.conv_id: r for r in chat.digest(chat.format_chats(df, part_bytes=part_bytes)).collect()}
        loss = chat.PLANTED * 2 + "<\\| <\\\\| \\n <|"
        assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
        assert got[2].loss_chars == 3 and len(got) == 5
    assert chat.format_chats(empty_like(df)).count() == 0
    assert {r.conv_id for r in chat.digests(empty_like(df)).collect()} == {-1}


def test_chat_parts_follow_small_batches(spark):
    """A conversation that spans many Arrow batches and parts stays in order."""
    df = spark.range(5000).selectExpr("id % 3 conv_id", "id turn", "'assistant' role", "concat('t', id) text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df, part_bytes=500)).collect()}
    for c in range(3):
        text = "".join(f"t{i}" for i in range(c, 5000, 3))
        assert got[c].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[c].n_turns == len(range(c, 5000, 3))


def test_warc_files_frames_and_revisits(spark):
    pages = spark.createDataFrame([(5, "u", "same", 1), (3, "u\r\nX: y", "same", 1), (9, None, None, 1), (8, "v", "", 1), (8, "v", "", 1),
                                   (None, "w", "same", 1), (20, "x", "y" * 300_000, 1), (21, "x", "é\r\n\r\nWARC/1.1", 1)],
                                  "page_id long, url string, html string, frame int")
    folder = shared_path(spark, "warc-test")
    index = warc.write_bundles(pages, folder, frame_bytes=1000).collect()
    assert len(index) == 8
    for r in index:
        headers, block = warc.read_one(r)
        assert headers["WARC-Record-ID"] == r.record_id and headers["WARC-Type"] == r.record_type
        frames = warc.read_seek_table(r.file)
        assert frames[r.frame][:2] == (r.frame_start, r.frame_bytes) and r.offset + r.length <= frames[r.frame][2]
    kinds = Counter((r.page_id, r.record_type) for r in index)
    assert kinds == {(3, "response"): 1, (5, "revisit"): 1, (None, "revisit"): 1, (8, "response"): 2, (9, "revisit"): 1, (20, "response"): 1, (21, "response"): 1}
    back = {(r.page_id, r.record_type): r for r in warc.round_trip(pages).collect()}
    assert back[5, "revisit"].refers_to == 3 and back[9, "revisit"].refers_to == 8 and back[20, "response"].payload_bytes == 300_000
    plain = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert set(plain.values()) == {"response"}
    assert warc.round_trip(empty_like(pages)).count() == 0


def _mix_brute(sources):
    """Targets by raising the level until no source is above three times its size."""
    names = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sources else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, stopped = sum(sources.values()), set()
    while True:
        level = (total - sum(3 * sources[s] for s in stopped)) / max(1, sum(weight[s] for s in names if s not in stopped))
        more = {s for s in names if s not in stopped and level * weight[s] > 3 * sources[s]}
        if not more:
            return {s: 3 * sources[s] if s in stopped else level * weight[s] for s in names}
        stopped |= more


def test_mix_targets_epochs_and_reruns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["big", "b", "é", None, "tiny"][min(4, int(rng.exponential(0.8)))]) for i in range(4000)]
    rows.append((9999, None, "empty"))
    docs = spark.createDataFrame([(i, t, s, "c") for i, t, s in rows], "doc_id long, text string, source string, copies string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes: Counter = Counter({s: 0 for *_, s in rows})
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = _mix_brute(sizes)
    taken: Counter = Counter()
    for r in got:
        assert r.size * 3 >= r.taken and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        epochs = math.floor(targets[r.source] / sizes[r.source]) if sizes[r.source] else 0
        assert r.taken in (0,) if r.size == 0 else r.taken // r.size in (epochs, epochs + 1)
        taken[r.source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 40
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())


def test_mix_sql_twin_with_stopped_sources(spark):
    import duckdb

    rows = [(i, "w " * (i % 37), ["big", "big", "big", "b", "c", None, "tiny"][0 if i % 50 else i // 50 % 7]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cur = con.execute(mixing.MIX_SQL)
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert len(want) == len(got) and any(w["target"] == pytest.approx(3 * w["source_size"]) for w in want)
    for w in want:
        r = got[w["doc_id"]]
        assert (r.size, r.taken, r.source_size, r.source) == (w["size"], w["taken"], w["source_size"], w["source"])
        assert r.target == pytest.approx(w["target"], rel=1e-12)


def test_mix_reruns_agree_with_null_and_equal_ids(spark):
    import duckdb

    rows = [(None if i % 2 else 7 if i % 4 else i, "w " * (i % 37) if i % 3 else "same text here", ["big", "big", "b", None][i % 4]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def taken(df):
        return Counter((r.doc_id, r.size, r.source, r.taken) for r in mixing.mix(df).collect())

    first = taken(docs)
    assert first == taken(docs.repartition(7)) == taken(docs.repartition(13, "text"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    cur = con.execute(mixing.MIX_SQL)
    names = [c[0] for c in cur.description]
    assert first == Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in (dict(zip(names, x)) for x in cur.fetchall()))
    out = [Counter(tuple(r) for r in mixing.mixed_rows(d).collect()) for d in (docs, docs.repartition(5))]
    assert out[0] == out[1]


def test_mix_prefers_better_documents(spark):
    docs = spark.createDataFrame([(i, ("good words here " * 20) if i % 2 else ("x " * 60), "s" if i < 3000 else "t") for i in range(6000)],
                                 "doc_id long, text string, source string")
    rows = [r for r in mixing.mix(docs).collect() if r.source == "s"]
    good, poor = (sum(r.copies > 0 for r in rows if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.3 * poor


def test_mix_edges(spark):
    docs = odd_docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty_like(docs)).count() == 0 and mixing.mixed_rows(empty_like(docs)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(nothing).collect())


def test_warc_reads_back_in_many_tasks(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(md5(cast(id as string)), 40) as html")
    assert warc.round_trip(pages, f"file://{tmp_path}/w").select(F.spark_partition_id()).distinct().count() > 1


def test_elias_fano_access_and_successor():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (1, 2 ** 63), (5, 10), (1000, 2000), (5000, 2 ** 64 - 1), (3000, 100), (0, 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano.build(v)
        assert (e.access(np.arange(n)) == v).all()
        ask = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
        place, equal = e.successor(ask)
        want = np.searchsorted(v, ask)
        assert (place == want).all() and (equal == np.isin(ask, v)).all()
    e = EliasFano.build(np.arange(10_000, dtype=U64) * U64(3))
    assert sum(a.nbytes for a in e.parts("x").values()) < 10_000  # 8 bytes each before
    codes, book = quantised(rng.normal(size=5000))
    assert codes.dtype == np.uint8 and len(book) == 256


class BruteLM:
    """The three-level model by dictionaries; ``bound`` is how far a token's log10 may be off by one byte a factor."""

    def __init__(self, learned):
        self.c = [Counter(), Counter(), Counter()]
        for t in learned:
            long = ["\n", *t]
            for k, grams in enumerate((t, zip(long, t), zip(long, t, t[1:]))):
                self.c[k].update(grams)
        self.kinds: Counter = Counter()
        for grams in self.c[1:]:
            self.kinds.update(g[:-1] for g in grams)
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.bound = 2 * math.log10(self.n / ngram_lm.DISCOUNT) / 256

    def chance(self, *g):
        low = (self.c[0][g[-1]] + 0.1) / (self.n + 0.1 * (self.v + 1)) if len(g) == 1 else self.chance(*g[1:])
        seen = 0 if len(g) == 1 else self.c[0][g[0]] if len(g) == 2 else self.c[1][g[:-1]]
        return (max(self.c[len(g) - 1][g] - 0.5, 0) + 0.5 * self.kinds[g[:-1]] * low) / seen if seen else low

    def score(self, t):
        return math.log10(self.chance("\n", t[0])) + sum(math.log10(self.chance(*g)) for g in zip(["\n", *t], t, t[1:]))


def test_lm_matches_brute_force(spark):
    docs = {r.doc_id: [w.decode() for w in (r.text or "").encode().lower().split()] + ["\n"] for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_ngram_lm"](spark, SF).collect()}
    model = BruteLM(docs[i] for i in docs if crc(i, 10))
    assert set(got) == set(docs)
    held = [0.0, 0.0]
    for i, words in docs.items():
        r = got[i]
        base = sum(math.log10(model.chance(w)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(model.c[0][w] > 0 for w in words), model.n)
        assert r.held_out == (crc(i, 10) == 0) and r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - model.score(words)) <= model.bound * len(words)
        if r.held_out:
            held[0] += base
            held[1] += r.score
    assert held[1] > held[0]  # the longer contexts help on texts not learned from


def test_lm_counts_every_bigram_and_trigram(spark):
    """Also with n-grams seen once, contexts dealt over several shards, and texts not learned from."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").limit(150).collect()] + [(-1, ""), (-2, None), (-3, "x"), (-4, "zz zz yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for i, t in rows}
    model = BruteLM(t for i, t in words.items() if i % 3)
    assert sum(x == 1 for x in model.c[1].values()) and sum(x == 1 for x in model.c[2].values())
    for shard_rows in (1 << 17, 2000):
        trie = ngram_lm.train(docs.filter("doc_id % 3 <> 0"), "text", shard_rows)
        assert (trie.firsts["bigram"][-1], trie.firsts["trigram"][-1]) == (len(model.c[1]), len(model.c[2]))
        for r in ngram_lm.scored(docs, "doc_id", "text", trie).collect():
            assert abs(r.score - model.score(words[r.doc_id])) <= model.bound * len(words[r.doc_id])


def test_lm_quantises_by_one_byte():
    values = 10.0 ** np.random.default_rng(2).uniform(-6, 0, 5000)
    got = ngram_lm.chances(values, "x")
    assert got["x.codes"].dtype == np.uint8
    assert np.abs(np.log10(got["x.book"][got["x.codes"]]) - np.log10(values)).max() <= 6 / 256 + 1e-6


def test_lm_edges(spark):
    odd = odd_docs(spark)
    rows = ngram_lm.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ngram_lm.score(empty_like(odd)).count() == 0
    only_held = odd.filter("crc32(cast(doc_id as string)) % 10 = 0")
    assert all(r.score == 0 and r.train_tokens == 0 for r in ngram_lm.score(only_held).collect())


def test_lm_hashes_words_over_whole_batches():
    def one(word):
        total = sum(int(ngram_lm.BYTE_NUMBERS[b]) * pow(ngram_lm.FACTOR, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
        return int(ngram_lm.mixed(np.array([total], U64))[0])

    texts = [b"A b  c", None, b"", b"x", b" y\n", b"zz\x0bq\x1f1", b"end", " Été".encode()]
    for some in (texts, texts[3:], texts[1:3]):
        got, lengths = ngram_lm.hashed(pa.array([b"before", *some, b"after"], pa.binary()).slice(1, len(some)))
        words = [[*(t or b"").lower().split(), b"\n"] for t in some]
        assert got.tolist() == [one(w) for ws in words for w in ws] and lengths.tolist() == [len(ws) for ws in words]
    long = b"q" * (2 * ngram_lm.HASH_BYTES + 5)
    got, _ = ngram_lm.hashed(pa.array([b"a " + long + b" b " + b"cd " * 100_000 + long, b"B"], pa.binary()))
    assert got[1] == got[-4]
    assert got[2] == got[-2] == one(b"b") and (got[3:100_003] == one(b"cd")).all() and ngram_lm.END not in got[:-3]


def test_lm_packs_keys():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 62, 1000))
    assert (ngram_lm.unpacked(ngram_lm.packed(keys)) == keys).all() and (ngram_lm.unpacked(ngram_lm.packed(keys[:1])) == keys[:1]).all()
