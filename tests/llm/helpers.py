"""Small document tables with every awkward case, and plain-Python twins of the operators."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, key string"


def odd_docs(spark):
    """Null, empty and very long texts, ties, repeated rows, null ids and labels, columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs to the river with a friend of the house in the wood. " * 2
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "x", "en", "b"),
        (5, prose, "en", "a"), (6, prose, "en", "b"), (6, prose, "en", "b"),
        (7, prose.replace("lazy", "sleepy"), "en", None), (8, "word " * 60_000, "en", "c"),
        (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", None, "c"),
        (10, "# | * < > & %", "de", "c"), (None, "a row without an id", "en", "a"), (12, "der die das und ein " * 9, "de", "b"),
        (13, "été ß \U0001f600 naïve", "fr", "b"), (14, "line one here\nline one here\nline one here", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, la, s, 0, "w", "s", "k", "y") for i, t, la, s in rows], DOC_SCHEMA)


def empty_like(df):
    return df.sparkSession.createDataFrame([], df.schema)


def crc(value, modulus):
    return zlib.crc32(str(value).encode()) % modulus


def jaccard_classes(texts, words_of, threshold=(4, 5)):
    """{id: (class, links)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = words_of((t or "").encode())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    posts = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posts[g].append(i)
    common = Counter(p for v in posts.values() for p in combinations(sorted(v), 2))
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if threshold[1] * n >= threshold[0] * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (root(i), links[i]) for i in sets}
