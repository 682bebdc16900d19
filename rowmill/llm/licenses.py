"""License scans by diagonal voting."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, materialize, row_keys
from rowmill.llm.tokens import Recent

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of well-known licenses and the labels that this method gives, in the words of the scan.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("odbl", "this database is made available under the open database license"),
]
#: Template positions up to which they are broadcast; more are joined by a shuffle.
BROADCAST_POSITIONS = 200_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_hashes = Recent(xxhash.xxh64_intdigest, most=120_000)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a to z and characters beyond ASCII, A to Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def rolling(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all k-grams of words, in order."""
    if len(words) < k:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a fixed phrase's words stand one after the other."""
    out = []
    for phrase, label in PHRASES.items():
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return out


def spans_by_vote(keyed: DataFrame, key: str, templates: Sequence[tuple[str, str]], *, k: int = 3, share: float = 0.5, shift: int = 2) -> DataFrame:
    """key and candidate spans (template, first and last word) by joining all rolling k-gram hashes to template positions.

    A hit at word p of template word t votes for the diagonal p - t. Diagonals at most `shift` apart are
    merged, and those stay that have at least a share of the template's k-grams. A few template positions are
    broadcast, so that no k-gram of a document is shuffled before it hits. Votes are counted by row, so rows without an id,
    or with one id, keep theirs apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in arrow_rows(batches, key, "text", most=500):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([rolling(words_of(t), k) for t in texts], pa.list_(pa.int64()))], names=["key", "grams"])

    spark = keyed.sparkSession
    rows = [(int(h), n, t) for n, (_, text) in enumerate(templates) for t, h in enumerate(rolling(text.encode().split(), k))]
    known = spark.createDataFrame(rows, "gram long, template int, t int")
    sizes = spark.createDataFrame([(n, len(text.split()) - k + 1) for n, (_, text) in enumerate(templates)], "template int, most int")
    if len(rows) <= BROADCAST_POSITIONS:
        known, sizes = F.broadcast(known), F.broadcast(sizes)
    hits = keyed.select(key, "text").mapInArrow(run, "key long, grams array<long>").select("key", F.posexplode("grams").alias("p", "gram")).join(known, "gram")
    votes = hits.groupBy("key", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > shift, F.lit(True))
    merged = votes.withColumn("group", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("key", "template", "group").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    good = merged.join(sizes, "template").where(F.col("votes") >= F.greatest(F.lit(1), share * F.col("most")))
    return good.groupBy("key").agg(F.collect_list(F.struct("template", "first", (F.col("last") + k).alias("end"))).alias("spans"))


SPANS = "array<struct<label:string,start:long,end:long,cover:double>>"


def scan(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), k: int = 3, cover: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the verified spans (label, start, end, cover).

    templates are (label, text) in the words of the scan: lower case, words between single spaces. Candidate spans are verified on
    the document's own words: a span stays if it has in order at least `cover` of its template's words. Fixed
    phrases are found apart from that, and score 1. Null and empty texts have no words, labels or score.
    Rows that repeat, null ids among them, are scanned each on their own words; other columns are ignored; an
    empty table gives no rows. Only the texts of rows with a candidate span are read again. Building the result writes the
    rows with keys and the candidates.
    """
    wanted = [(label, text.encode().split()) for label, text in templates]

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, texts in arrow_rows(batches, key, "doc_id", "text", most=500):
            out = []
            for row, doc, text in zip(keys, ids, texts):
                words = words_of(text)
                found = phrase_places(words)
                places = [p for p, _ in found]
                out.append((row, doc, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 6, pa.string()])], names=["key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, spans in arrow_rows(batches, "key", "text", "spans", most=500):
            out = []
            for text, voted in zip(texts, spans):
                words, found = words_of(text), []
                for s in voted:
                    label, want = wanted[s["template"]]
                    first = max(0, s["first"])
                    part = sum(m.size for m in SequenceMatcher(None, words[first : s["end"]], want, autojunk=False).get_matching_blocks()) / len(want)
                    if part >= cover:
                        found.append((label, first, s["end"], min(1.0, part)))
                out.append([dict(zip(("label", "start", "end", "cover"), f)) for f in sorted(found)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, span)], names=["key", "spans"])

    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
    keyed, key = row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "keyed")
    voted = materialize(spans_by_vote(keyed, key, templates, k=k), "voted")
    verified = keyed.select(F.col(key).alias("key"), "text").join(voted, "key").mapInArrow(verify, f"key long, spans {SPANS}")
    rows = keyed.mapInArrow(base, "key long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    out = rows.join(materialize(verified, "verified"), "key", "left").drop("key").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    every = F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.transform("spans", lambda s: s["label"])))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", F.array_sort(every)).alias("labels"), score.alias("score"), "spans")
