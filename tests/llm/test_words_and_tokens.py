"""Benchmark decontamination, spelling variants and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty_like, odd_docs

from postlab.llm import alignment, decontaminate, spelling
from postlab.llm.catalog import QUERIES
from postlab.llm.common import table

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- op11
def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _hits(docs, items, window=10):
    """{row: (n_words, hit places, items)}"""
    wins = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k:k + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out.append((doc, len(w), hit, sorted(found)))
    return out


def _told(rows):
    return Counter((d, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)) for d, n, hit, items in rows)


def _report(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_decontamination_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = _hits(docs, items)
    assert _report(QUERIES["op11_decontaminate"](spark, SF)) == _told(want) and sum(bool(h) for *_, h, _ in want) > 10


ITEMS = [(1, "One two three four five six seven eight nine ten, eleven twelve"), (2, "short ITEM here"), (None, "a b c d e f g h i j"),
         (2, "TWO three four five six seven eight nine ten eleven"), (3, None), (4, " .,! "), (5, "İstanbul ΣΑΣ' Σ k"), (10, "x")]
TEXTS = ["zero one TWO-three four\nfive six seven eight nine ten eleven twelve. end", "a short\titem here, short item here", None, "", " . ",
         "a b c d e f g h i j k a b c d e f g h i j", "İstanbul ΣΑΣ' Σ k", "istanbul σας σ k", "x y", "one two three four five six seven eight nine",
         "w " * 30_000 + "short item here"]


def _small(spark):
    docs = spark.createDataFrame([(i if i % 4 else None, t, "z", "q") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, uid string, items string")
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, print string")
    return docs, items


@pytest.mark.parametrize("set_windows", [1 << 20, 3])
def test_decontamination_edges_and_large_benchmarks(spark, set_windows):
    docs, items = _small(spark)
    want = _hits([(i if i % 4 else None, t) for i, t in enumerate(TEXTS + TEXTS)], ITEMS)
    assert _report(decontaminate.report(docs, items, set_windows=set_windows)) == _told(want)
    assert decontaminate.report(empty_like(docs), items, set_windows=set_windows).count() == 0
    none = decontaminate.report(docs, empty_like(items), set_windows=set_windows).collect()
    assert len(none) == len(want) and not any(r.contaminated or r.n_items for r in none)


def test_spans_or_documents_are_removed(spark):
    docs, items = _small(spark)
    want = _hits([(i, t) for i, t in enumerate(TEXTS + TEXTS)], ITEMS)
    kept = decontaminate.without_documents(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter((TEXTS + TEXTS)[i] for i, _, hit, _ in want if not hit)
    cleaned = decontaminate.without_spans(docs, items)
    assert cleaned.columns == docs.columns and cleaned.count() == len(want)
    left = Counter(" ".join(_words(r.text)) for r in cleaned.collect())
    assert left == Counter(" ".join(w for k, w in enumerate(_words((TEXTS + TEXTS)[i])) if k not in hit) for i, _, hit, _ in want)
    assert "zero. end" in {r.text for r in cleaned.collect()}


def test_decontamination_runs_without_python(spark):
    docs, items = _small(spark)
    for df in (decontaminate.report(docs, items), decontaminate.without_spans(docs, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- op12
def _variants(rows, shortest=7):
    counts = Counter()
    for i, t in rows:
        counts.update(spelling.words_of("" if i is None else str(i), t, shortest))
    words = {w: n for w, n in counts.items() if n >= 2}
    near, same = defaultdict(set), defaultdict(list)
    for w in words:
        for p in range(len(w)):
            x = w[:p] + w[p + 1:]
            if x in words:
                near[w].add(x)
                near[x].add(w)
            same[w[:p], w[p + 1:]].append(w)
    for group in same.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def _got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = _variants(rows)
    assert _got(QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(v[0] is not None for v in want.values()) > 50


def test_spelling_rule_of_the_lost_code_point():
    import zlib

    runs = [f"Worté{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst"]
    got = spelling.words_of("7", " ".join(runs), 7)
    want = Counter()
    for run in runs:
        run = run.replace("W", "w")
        h = zlib.crc32(f"7:{run}".encode())
        run = run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]
        want.update([run] if len(run) >= 7 else [])
    assert got == want and len({len(w) for w in want}) == 2
    assert spelling.words_of("1", "ÀÉ×÷ßÿabc ŁOdzłŁabcdefgh", 7) == Counter({"ÀÉ×÷ßÿabc": 1, "abcdefgh": 1})


def test_spelling_edges_repeats_chains_and_long_words(spark, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abc") for _ in range(60))
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "abababa", "éßÿàéßÿ", "éßÿàéßÿé", base[:40], base[:41], base[:39], base[:20] + base[21:41],
             base[:30] + "z" + base[31:41], base[:41] + "q", base, "x" + base, base[1:], base[:8] + base[9:]]
    rows = [(k, " ".join([w] * (1 + 300 // (10 ** (j % 3))))) for j, w in enumerate(words) for k in (2 * j, 2 * j + 1)] + [(None, None), (1, ""), (None, "aaaaaaa aaaaaaa")]
    rows += [(200 + k, " ".join(["kettles"] * 200 + ["kettlea"] * 15 + ["kettleaa"])) for k in range(9)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = _variants(rows)
    assert _got(spelling.variants(docs)) == want and any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.variants(empty_like(docs)).count() == 0
    odd = odd_docs(spark)
    assert _got(spelling.variants(odd)) == _variants([(r.doc_id, r.text) for r in odd.collect()])
    monkeypatch.setattr(spelling, "LONG", 9)
    assert _got(spelling.variants(docs)) == want


# ---------------------------------------------------------------- op13
@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(*alignment.tokenizer_paths())


def _aligned(encoders, text):
    """(n_a, n_b, n_groups, n_links, digest, links) of the whole text at once, by decoded bytes alone."""
    nothing = (0, 0, 0, 0, "", {})
    if not text:
        return nothing
    raw, sides = f" {text}".encode(), []
    ids = (encoders.a.encode(f" {text}", add_special_tokens=False).ids, encoders.b.encode(text))
    for found, spelled in zip(ids, (encoders.bytes_a, encoders.bytes_b)):
        if b"".join(spelled[i] for i in found) != raw:
            return nothing
        sides.append((found, np.cumsum([len(spelled[i]) for i in found]).tolist()))
    (a, ends_a), (b, ends_b) = sides
    i = j = 0
    groups, links = [], Counter()
    for cut in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((a[i:i2], b[j:j2]))
        links.update((x, y) for x in a[i:i2] for y in b[j:j2])
        i, j = i2, j2
    digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
    return len(a), len(b), len(groups), sum(links.values()), digest, dict(links)


def _expected(encoders, rows):
    found = [(i, _aligned(encoders, t)) for i, t in rows]
    holders, most = Counter(), defaultdict(int)
    for _, x in found:
        holders.update(x[5].keys())
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return Counter((i, *x[:4], sum(m for p, m in x[5].items() if holders[p] == most[p[0]]), sum(m * holders[p] for p, m in x[5].items()), x[4])
                   for i, x in found)


def _counted(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


STRANGE = ["été <s> naïve \U0001f600 <0x41> a  b\n\tc 漢𠀀", "", None, "a ▁ b", "<|endoftext|> x  </s>", "   ", "x", "  a\x00b ﬁ", " lead trail ", "ﷺ" * 20,
           "tab\t\tnew\r\n\r\n  end", "a,b. c.\nd!\n\n e　f g\x1ch", "\nab.\ncd", "it's. x’s, don't", "1,2. 3: x:", "été. naïve, ß!", "été。漢。 字", "x?! y!? z...",
           "\n", "\n\n", "a\n", " a", "é\né é.\n.é", "=" * 3000, "🙂" * 300, "word " * 3000, "á ̈b c​d e f"]


def test_alignment_query_matches_brute_force(spark, encoders):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").limit(300).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _counted(alignment.align(docs, block_pairs=5000)) == _expected(encoders, rows)
    assert QUERIES["op13_token_alignment"](spark, SF).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_edges(spark, encoders):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(STRANGE + STRANGE)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_a string, block int")
    assert _counted(alignment.align(docs)) == _expected(encoders, rows)
    assert alignment.align(empty_like(docs)).count() == 0
    odd = odd_docs(spark)
    assert _counted(alignment.align(odd)) == _expected(encoders, [(r.doc_id, r.text) for r in odd.collect()])


def test_units_many_links_and_forgetting_change_nothing(encoders, monkeypatch):
    texts = STRANGE + [r * 3 for r in STRANGE if r]
    want = [_aligned(encoders, t) for t in texts]
    for limit, many in ((10 ** 6, 4096), (5, 4096), (10 ** 6, 0)):
        monkeypatch.setattr(alignment, "MANY_LINKS", many)
        aligner = alignment.Aligner(encoders, limit)
        for at in range(0, len(texts), 7):
            some, got = texts[at:at + 7], aligner(texts[at:at + 7])
            for k in range(len(some)):
                links = {(p >> alignment.ID_BITS, p & ((1 << alignment.ID_BITS) - 1)): t for p, t in zip(got["pairs"][k].tolist(), got["times"][k].tolist())}
                assert (*(got[x][k] for x in alignment.FIGURES), got["digest"][k], links) == want[at + k], some[k]


def test_spans_agree_with_decoded_bytes_between_characters(encoders):
    """Where no token ends inside a character, the libraries' spans alone give the ends."""
    units = [("naïve", " "), ("word", " "), ("\nline", ""), (",", "\n"), ("été", " "), ("漢", " ")]
    whole, (ids_a, ends_a, unit_a, ids_b, ends_b, unit_b) = encoders.encoded(units)
    assert all(whole)
    raw = b"".join((f" {u}" if f == " " else u).encode() for u, f in units)
    for ids, ends, spelled in ((ids_a, ends_a, encoders.bytes_a), (ids_b, ends_b, encoders.bytes_b)):
        assert b"".join(spelled[i] for i in ids) == raw and ends.tolist() == np.cumsum([len(spelled[i]) for i in ids]).tolist()
