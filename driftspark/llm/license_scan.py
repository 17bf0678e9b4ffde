"""License scan: an exact set-similarity join of text blocks with license templates.

A block is any window of ``2 * |T|`` consecutive words (the whole text, if shorter), T being a template's token set. A
block joins a template when it holds at least ``THRESHOLD`` of the template's distinct tokens, and all of those without
which the template says something else (the license's own name). Tokens are ordered by their frequency over all
documents, rarest first, and exact filters apply:

* length: a text of fewer than ``need = ceil(THRESHOLD * |T|)`` words holds no such block;
* prefix: a block that joins holds one of the ``|T| - need + 1`` rarest tokens of T, so only blocks around the places of
  these, the seeds, are looked at;
* position: the rarest token that a block shares with T is a seed at some position of T's order, and the block's other
  shared tokens have later positions and stand less than a block from it. A seed around which fewer than ``need`` tokens
  of its own or later positions stand is dropped.

Every block that joins is returned; neighbouring ones overlap in all but a word, so they are given as maximal runs, from
the start of the first to the end of the last. A template whose tokens are all among another's (CC BY and CC BY-NC) gives
way to it where their runs overlap.

Only templates and the counts of their own tokens are broadcast; both are bounded by the templates, not by the data.
Beside the join, fixed phrases are counted wherever their words stand consecutively.

Defined results: a null or wordless text has no label, score 0 and null positions; every row keeps its row; an empty table
gives none; texts of any length are scanned whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import alnum_words, map_batches, pieces, text_bytes

#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: License notices and passages, their labels, and the tokens that a block has to hold.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission granted software restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache compliance license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license redistribute"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license redistribute"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license redistribute"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
THRESHOLD = 0.8
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, blocks array<struct<label: string, template: int, start: long, end: long, containment: double>>"
)


def vocabulary() -> dict[bytes, int]:
    """Ids (from 1) of all words of templates and phrases."""
    out: dict[bytes, int] = {}
    for text in [t for _, t, _ in TEMPLATES] + [p for p, _ in PHRASES]:
        for w in alnum_words(text.encode()):
            out.setdefault(w, len(out) + 1)
    return out


def token_counts(documents: DataFrame) -> dict[bytes, int]:
    """How often each template token stands in all documents: partial counts per batch, summed by token."""
    vocab = vocabulary()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes = text_bytes(b.column("text"))
        total: Counter = Counter()
        for i in range(len(texts)):
            if texts[i]:
                total.update(filter(vocab.__contains__, alnum_words(texts[i])))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"]
        )

    found = map_batches(documents.select("text"), batch, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Matcher:
    """Templates as id sets in global frequency order, with their prefixes."""

    def __init__(self, counts: dict[bytes, int], threshold: float = THRESHOLD):
        self.vocab = vocabulary()
        self.sets = []
        for label, text, own in TEMPLATES:
            tokens = sorted(set(alnum_words(text.encode())), key=lambda w: (counts.get(w, 0), w))
            ids = [self.vocab[w] for w in tokens]
            need = ceil(threshold * len(ids) - 1e-9)
            rank = {t: r for r, t in enumerate(ids)}
            self.sets.append((label, rank, need, ids[: len(ids) - need + 1], [rank[self.vocab[w]] for w in alnum_words(own.encode())]))
        #: For each template, those of other labels that have all of its tokens and more.
        self.wider = [[j for j, y in enumerate(self.sets) if y[0] != x[0] and set(x[1]) < set(y[1])] for x in self.sets]
        self.phrases = [([self.vocab[w] for w in alnum_words(p.encode())], label) for p, label in PHRASES]
        self.rank_of = np.full((len(self.sets), len(self.vocab) + 1), -1)
        self.is_prefix = np.zeros(self.rank_of.shape, bool)
        for k, (_, rank, _, prefix, _) in enumerate(self.sets):
            self.rank_of[k, list(rank)] = list(rank.values())
            self.is_prefix[k, prefix] = True
        self.any_prefix = self.is_prefix.any(axis=0)

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = ids[:n] == phrase[0]
                for j, t in enumerate(phrase[1:], 1):
                    hit &= ids[j : n + j] == t
                if hit.any():
                    places += np.flatnonzero(hit).tolist()
                    labels.add(label)
        return places, labels

    def seeds(self, k: int, at: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of template k's prefix tokens that the positional filter leaves, and places and positions of all of its
        tokens."""
        positions = self.rank_of[k][known]
        mine, positions = at[positions >= 0], positions[positions >= 0]
        prefix = positions < len(self.sets[k][3])
        seeds, rarest = mine[prefix], positions[prefix]
        around = np.zeros(len(seeds), np.int64)
        for r in np.unique(positions).tolist():
            there = mine[positions == r]
            near = np.searchsorted(there, seeds + width) > np.searchsorted(there, seeds - width, "right")
            around += near & (rarest <= r)
        return seeds[around >= self.sets[k][2]], mine, positions

    def runs(self, k: int, n: int, at: np.ndarray, known: np.ndarray) -> list[tuple[float, int, int]]:
        """Maximal runs of blocks that join template k: (best containment, start of the first, end of the last)."""
        _, rank, need, _, own = self.sets[k]
        if n < need:
            return []
        width = min(2 * len(rank), n)
        seeds, mine, ranks = self.seeds(k, at, known, width)
        if not len(seeds):
            return []
        # only blocks that hold a seed can join: tokens farther than a block from all seeds are in no such block
        i = np.searchsorted(seeds, mine)
        left, right = mine - seeds[np.maximum(i - 1, 0)], seeds[np.minimum(i, len(seeds) - 1)] - mine
        near = (np.abs(left) < width) | (np.abs(right) < width)
        mine, ranks = mine[near], ranks[near]
        # starts at which what a block holds can change
        breaks = np.unique(np.concatenate([np.maximum(mine - width + 1, 0), mine + 1]))
        places, ranks = mine.tolist(), ranks.tolist()
        inside, i, j, out, start, best = Counter(), 0, 0, [], None, 0
        for s in breaks[breaks <= n - width].tolist():
            while j < len(places) and places[j] < s + width:
                inside[ranks[j]] += 1
                j += 1
            while i < j and places[i] < s:
                inside[ranks[i]] -= 1
                if not inside[ranks[i]]:
                    del inside[ranks[i]]
                i += 1
            held = len(inside)
            if held >= need and all(r in inside for r in own):
                start, best = (s, held) if start is None else (start, max(best, held))
            elif start is not None:
                out.append((best / len(rank), start, s - 1 + width))
                start = None
        if start is not None:
            out.append((best / len(rank), start, n))
        return sorted(out)

    def join(self, ids: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """Maximal runs of blocks that join a template: (label, template, start of the first block, end of the last one,
        best containment), by template, then containment, then start."""
        at = np.flatnonzero(ids)
        known = ids[at]
        if not self.any_prefix[known].any():
            return []
        found = {k: runs for k in range(len(self.sets)) if self.is_prefix[k][known].any() and (runs := self.runs(k, len(ids), at, known))}
        out = []
        for k, runs in found.items():
            taken = [(a, b) for j in self.wider[k] for _, a, b in found.get(j, ())]
            out += [(self.sets[k][0], k, a, b, x) for x, a, b in runs if not any(a < d and c < b for c, d in taken)]
        return out


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for every document: base phrases, joined blocks, labels of both, and the best containment as score."""
    shared = documents.sparkSession.sparkContext.broadcast(Matcher(token_counts(documents), threshold))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        matcher = shared.value
        get = matcher.vocab.get
        texts, sizes = text_bytes(b.column("text"))
        rows = []
        for lo, hi in pieces(sizes):
            for i in range(lo, hi):
                words = alnum_words(texts[i]) if texts[i] else []
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                places, base = matcher.base(ids)
                blocks = matcher.join(ids)
                labels = base | {x[0] for x in blocks}
                rows.append(
                    (
                        len(words),
                        len(places),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(labels)),
                        max((x[4] for x in blocks), default=0.0),
                        [dict(zip(("label", "template", "start", "end", "containment"), x, strict=True)) for x in blocks],
                    )
                )
        kind = pa.struct(
            [
                ("label", pa.string()),
                ("template", pa.int32()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("containment", pa.float64()),
            ]
        )
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(kind)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=names)

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch, SCHEMA)
