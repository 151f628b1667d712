"""Operator 1, license scan: template markup compiled into token automata.

A template is license wording with two kinds of markup: ``[[ ... ]]`` encloses words that may be missing
(nesting is allowed) and ``{{n}}`` stands for a replaceable region of up to n words (names, years, places).
Each template becomes an automaton over words; a text passage is accepted when the mandatory words match
exactly, in order. Phrases (plain word sequences) are counted besides, at every place.

The scan runs where a document is read, one Arrow batch at a time, without any shuffle. A document that
holds none of the templates' rarest mandatory words is passed over after one set test.

Defined results: a null text counts as empty and an empty text has no words, no labels and score 0; rows are
judged one by one, so repeated rows repeat their results; an empty table gives an empty result; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: (label, wording) — public license wording, as templates.
TEMPLATES = [
    ("mit", "[[this {{4}} is]] [[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction "
            "[[including without limitation the rights to use copy modify merge publish distribute sublicense and or "
            "sell copies of the software {{60}} the software is provided as is]]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("apache-2", "[[{{4}} is]] licensed under the [[terms of the]] apache license version 2 [[0]] [[the license you may "
                 "not use this file except in compliance with the license]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("gpl-3", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license [[as published by the "
              "free software foundation]] [[either]] version 3"),
    ("gpl-2", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license [[as published by the "
              "free software foundation]] [[either]] version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license"),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license [[as published by the free software "
               "foundation]] [[either]] version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "[[this {{4}} is]] licensed under [[a]] [[the]] cc by nc [[4 0]] [[3 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[{{2}}]] [[4 0]] [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa [[4 0]] [[3 0]]"),
    ("cc-by", "creative commons attribution [[4 0]] [[3 0]] [[international]] license"),
    ("cc0", "cc0 [[1 0]] universal [[public domain dedication]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright [[c]] {{6}} all rights reserved"),
]

#: Maps A-Z to a-z and every other ASCII character that is no letter or digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MARKUP = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")
SCHEMA = ("{id} {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, matches array<struct<label:string,start:long,words:long>>")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Word automaton of one template: per state its word steps, whether any word may step, and free steps."""

    def __init__(self, label: str, wording: str):
        self.label = label
        self.steps: list[dict[bytes, int]] = []
        self.any: list[int | None] = []
        self.free: list[list[int]] = []
        self.mandatory: list[bytes] = []
        here, opened = self._state(), []
        self.start = here
        for m in MARKUP.finditer(wording):
            if m[0] == "[[":
                opened.append(here)
            elif m[0] == "]]":
                after = self._state()
                self.free[here].append(after)
                self.free[opened.pop()].append(after)
                here = after
            elif m[1]:
                chain = [here]
                for _ in range(int(m[1])):
                    chain.append(self._state())
                    self.any[chain[-2]] = chain[-1]
                after = self._state()
                for s in chain:
                    self.free[s].append(after)
                here = after
            else:
                word = m[0].encode().translate(FOLD).strip()
                after = self._state()
                self.steps[here][word] = after
                if not opened:
                    self.mandatory.append(word)
                here = after
        if opened or not self.mandatory:
            raise ValueError(f"template of {label}: unclosed region or no mandatory word")
        self.final = here
        self.closed = [self._closure(s) for s in range(len(self.steps))]
        self.first = {w for s in self.closed[self.start] for w in self.steps[s]}
        self.starts_anywhere = any(self.any[s] is not None for s in self.closed[self.start])

    def _state(self) -> int:
        self.steps.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.steps) - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], at: int) -> int:
        """Length of the longest accepted run that begins at ``at``; 0 if none does."""
        states, best, i, n = self.closed[self.start], 0, at, len(words)
        while states and i < n:
            word, after = words[i], set()
            for s in states:
                if (t := self.steps[s].get(word)) is not None:
                    after |= self.closed[t]
                if (t := self.any[s]) is not None:
                    after |= self.closed[t]
            i += 1
            if self.final in after:
                best = i - at
            states = after
        return best


class Scanner:
    """All templates and phrases of a scan, indexed by first word."""

    def __init__(self, templates=None, phrases=None):
        self.automata = [Automaton(*t) for t in (TEMPLATES if templates is None else templates)]
        self.phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases)]
        self.by_first: dict[bytes, list[Automaton]] = {}
        self.anywhere = [a for a in self.automata if a.starts_anywhere]
        for a in self.automata:
            for w in a.first:
                self.by_first.setdefault(w, []).append(a)
        self.phrase_first: dict[bytes, list] = {}
        for p, label in self.phrases:
            self.phrase_first.setdefault(p[0], []).append((p, label))
        longest = [max(a.mandatory, key=len) for a in self.automata] + [max(p, key=len) for p, _ in self.phrases]
        self.anchors = set(longest)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str, int]], list[tuple[str, int, int]]]:
        """(start, label, words) of each phrase place; (label, start, words) of the accepted passages.

        Of passages that one automaton accepts, those inside a longer one of its own are left out."""
        if self.anchors.isdisjoint(words):
            return [], []
        have = set(words)
        live = {id(a) for a in self.automata if have.issuperset(a.mandatory)}
        anywhere = [a for a in self.anywhere if id(a) in live]
        base, found, reach = [], [], {}
        for i, w in enumerate(words):
            for p, label in self.phrase_first.get(w, ()):
                if words[i:i + len(p)] == p:
                    base.append((i, label, len(p)))
            for a in anywhere + [a for a in self.by_first.get(w, ()) if id(a) in live and not a.starts_anywhere]:
                n = a.longest(words, i)
                if n and i + n > reach.get(id(a), 0):
                    reach[id(a)] = i + n
                    found.append((a.label, i, n))
        return base, found


def covered(spans: list[tuple[int, int]]) -> int:
    end = total = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None) -> DataFrame:
    """One row per document: word count, phrase places, labels of phrases and of accepted passages, the passages,
    and as score the share of words that lie in a phrase place or an accepted passage."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    schema = SCHEMA.format(id=f"`{id_col}`", id_type=docs.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for text in batch.column(1):
                words = words_of(text.as_py())
                base, found = scanner.scan(words)
                starts = [b[0] for b in base]
                base_labels, labels = {b[1] for b in base}, {f[0] for f in found}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base_labels)))
                out["labels"].append(",".join(sorted(base_labels | labels)))
                spans = [(i, n) for i, _, n in base] + [(i, n) for _, i, n in found]
                out["score"].append(covered(spans) / len(words) if words else 0.0)
                out["matches"].append([{"label": a, "start": i, "words": n} for a, i, n in found])
            fields = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [
                pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *out])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("license_text")).mapInArrow(run, schema)
