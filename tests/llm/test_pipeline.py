"""The corpus pipeline against the stages' brute-force twins, each on its own input."""

import re
from collections import Counter

from helpers import jaccard_classes

import corpus_pipeline
from postlab.llm import quality
from postlab.llm.common import table, written
from postlab.llm.licenses import words_of

SF = "/root/testdata/sf0.01"


def test_every_stage_on_what_the_one_before_kept(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language id", "near-duplicates", "source mix", "packing"]
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name.replace(' ', '-')}")
        seen.append(docs)
    raw, good, known, single, mixed, packed = (x.collect() for x in seen)
    assert all(x.columns == seen[0].columns for x in seen[:-1])
    # quality: exactly the rows whose verdict is kept
    kept = {r.doc_id for r in quality.quality(seen[0]).collect() if r.kept}
    assert Counter(r.doc_id for r in good) == Counter(r.doc_id for r in raw if r.doc_id in kept)
    assert {r.doc_id for r in known} <= kept and len(known) >= 0.99 * len(good)
    # near-duplicates: one of each class
    classes = jaccard_classes({r.doc_id: r.text for r in known}, words_of)
    assert {r.doc_id for r in single} == {c for c, _ in classes.values()} and len(single) == len({c for c, _ in classes.values()})
    # mix: copies of the rows, near the targets
    sizes = Counter()
    for r in single:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    order = sorted(sizes)
    total = sum(sizes.values())
    share = {s: total * (1 + k % 3) / sum(1 + j % 3 for j in range(len(order))) for k, s in enumerate(order)}
    got = Counter()
    for r in mixed:
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    for s in order:
        if max(share.values()) < 3 * min(sizes.values()):
            assert abs(got[s] - share[s]) <= max(len(r.text.split()) for r in single)
    # packing: every row of the mix once
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    assert corpus_pipeline.run(spark, SF).columns == seen[-1].columns
