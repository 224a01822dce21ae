"""License scans by diagonal voting (operator 9).

Every whole text is cut into words, and each run of two words is hashed. Spark joins these rolling hashes with the places of the
same hashes in templates (short phrases and license notices). Hits are counted by
document, template and diagonal (place in the text minus place in the template). Neighbouring diagonals are merged in bands, which
lets words be missing or added, and a band with enough votes is verified against the words of the text.

A verified span has least_coverage of its template's words in order, and is so much of the span's own words too. So its diagonals differ by no more than a share of the
template's length; a band is twice as wide and begins anew after each half, so every such span lies in one band, and a band never asks for more words than about two templates have.
least_votes is low enough for any such span: with 0.8 of n words covered, at least 0.4 n - 1 of the runs of two words are whole, 0.3 of them from seven words on.

Defined results. Null text counts as empty: no words, no places, empty labels, score 0. A phrase counts at every place where all its words
stand consecutively. Of notices of unlike labels in the same place, those of the highest coverage count. Rows with equal doc_id and text share their votes (which only propose spans) and get equal results.
An empty table gives no rows. Very long texts are read whole. Given columns whose names the result needs get an underscore.

Skew: the templates are broadcast up to max_broadcast bytes (counted first), beyond that they are joined by shuffle. Votes are counted on the map side first and are then dealt by document, template and diagonal,
so no document's votes are gathered. Only texts with spans are shuffled, to meet them, in a join whose large partitions AQE splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.arrow import grams, per_text, raw, settled, slices, texts, word_hashes, word_spans
from strata.llm.common import among, col, materialise, named_apart, row_hash, table, text_of, with_row
from strata.runtime import ship

GRAM = 2
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening passages of public licenses and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "the contents of this file are subject to the terms of the common development and distribution license": "cddl",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this font software is licensed under the sil open font license": "ofl",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl",
}
FOUND = "array<struct<label:string,start:long,words:long,coverage:double,base:boolean>>"
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _templates(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[list[str], str, bool]]:
    return [(k.split(), v, base) for group, base in ((phrases, True), (notices, False)) for k, v in group.items()]


def _template_grams(templates: list[tuple[list[str], str, bool]]) -> list[tuple[int, int, int]]:
    out = []
    for t, (words, _, _) in enumerate(templates):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        _, _, hashes = word_hashes(data, np.array([0, len(data)]), _OUTSIDE[data])
        out += [(int(h), t, i) for i, h in enumerate(grams(hashes, GRAM).view(np.int64).tolist())]
    return out


def text_grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, hash and grams: the hashes of all runs of two words of each text."""

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                data, bounds = raw(column.slice(a, b - a))
                starts, _, hashes = word_hashes(data, bounds, _OUTSIDE[data])
                at = per_text(starts, bounds)
                counts = np.diff(at)
                of = np.repeat(np.arange(len(counts)), counts)
                inside = of[: -(GRAM - 1)] == of[GRAM - 1 :] if len(of) >= GRAM else np.empty(0, bool)
                flat = grams(hashes, GRAM)[inside].view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.maximum(counts - GRAM + 1, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "hash", "grams"])

    rows = docs.select(col(id_col).cast("long").alias("doc"), row_hash(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, "doc long, hash long, grams array<long>")


def band_width(words: int, least_coverage: float) -> int:
    """How far the diagonals of a span can lie apart that covers so much of a template of so many words, and of itself."""
    return max(1, math.ceil(words * (1 / least_coverage - 1)) + math.ceil(words * (1 - least_coverage)))


def candidate_spans(docs: DataFrame, templates: list[tuple[list[str], str, bool]], id_col: str, text_col: str, least_votes: float, least_coverage: float, max_broadcast: int) -> DataFrame:
    """doc, hash and spans (template, first and last diagonal): places of phrases, and bands of diagonals with enough votes for a notice."""
    spark = docs.sparkSession
    where = _template_grams(templates)
    small = F.broadcast if 24 * (len(where) + len(templates)) <= max_broadcast else lambda x: x
    places = spark.createDataFrame(where, "gram long, template int, at int")
    sizes = spark.createDataFrame([(t, len(w) - GRAM + 1, band_width(len(w), least_coverage), base) for t, (w, _, base) in enumerate(templates)], "template int, size int, width int, base boolean")
    rolled = text_grams(docs, id_col, text_col).select("doc", "hash", F.posexplode("grams").alias("place", "gram"))
    hits = rolled.join(small(places), "gram")
    votes = hits.groupBy("doc", "hash", "template", (F.col("place") - F.col("at")).cast("long").alias("diagonal")).agg(F.count("*").alias("votes"))
    voted = votes.join(small(sizes), "template")
    exact = voted.where("base and votes >= size").select("doc", "hash", F.struct("template", F.col("diagonal").alias("start"), F.col("diagonal").alias("end")).alias("span"))
    block = F.floor(F.col("diagonal") / F.col("width"))
    bands = voted.where("not base").withColumn("band", F.explode(F.array(block - 1, block))).groupBy("doc", "hash", "template", "size", "width", "band").agg(F.sum("votes").alias("votes"))
    first = F.col("band") * F.col("width")
    near = bands.where(F.col("votes") >= least_votes * F.col("size")).select("doc", "hash", F.struct("template", first.alias("start"), (first + 2 * F.col("width") - 1).alias("end")).alias("span"))
    return exact.unionByName(near).groupBy("doc", "hash").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def best_span(wanted: list[str], words: list[str], first: int, last: int, least_coverage: float) -> tuple[int, int, float] | None:
    """Start, number of words and coverage of the place on diagonals first to last that is covered best: words in order, as a share of the template and of the place."""
    a = max(0, first)
    same = [m for m in SequenceMatcher(None, wanted, words[a : last + len(wanted)], autojunk=False).get_matching_blocks() if m.size and first <= a + m.b - m.a <= last]
    best = None
    for i in range(len(same)):
        total = 0
        for m in same[i:]:
            total += m.size
            span = m.b + m.size - same[i].b
            coverage = total / max(len(wanted), span)
            if coverage >= least_coverage and (best is None or coverage > best[2]):
                best = (a + same[i].b, span, coverage)
    return best


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, columns: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", least_votes: float = 0.3, least_coverage: float = 0.8, max_broadcast: int = 8 << 20) -> DataFrame:
    """The given columns, n_words and found: verified spans with label, first word, number of words, coverage, and whether it is a phrase."""
    ship(docs.sparkSession)
    templates = _templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    spans = materialise(candidate_spans(docs, templates, id_col, text_col, least_votes, least_coverage, max_broadcast), "license-spans").withColumnsRenamed({"doc": "of", "hash": "of_hash"})
    rows = docs.select(F.struct(*(col(c) for c in columns)).alias("row"), text_of(text_col).alias("text"), col(id_col).cast("long").alias("doc"), row_hash(text_of(text_col)).alias("hash"))
    has_spans = among(spans.select(F.xxhash64("of", "of_hash").alias("key")), "key")(F.xxhash64("doc", "hash"))
    met = rows.where(has_spans).join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left").select("row", "text", "spans")
    met = met.unionByName(rows.where(~has_spans).select("row", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))

    def outdone(f: dict, g: dict) -> bool:
        """Whether another label's notice g is covered better in the same place: half of the shorter span or more lies in both."""
        shared = min(f["start"] + f["words"], g["start"] + g["words"]) - max(f["start"], g["start"])
        return not g["base"] and f["label"] != g["label"] and g["coverage"] > f["coverage"] and 2 * shared >= min(f["words"], g["words"])

    def verify(words: list[str], spans_: list[dict]) -> list[dict]:
        out = []
        for s in spans_:
            wanted, label, base = templates[s["template"]]
            if base:
                if words[s["start"] : s["start"] + len(wanted)] == wanted:
                    out.append({"label": label, "start": s["start"], "words": len(wanted), "coverage": 1.0, "base": True})
            elif found := best_span(wanted, words, s["start"], s["end"], least_coverage):
                new = {"label": label, "start": found[0], "words": found[1], "coverage": found[2], "base": False}
                if new not in out:  # a span on a narrow run of diagonals lies in two bands
                    out.append(new)
        return [f for f in out if f["base"] or not any(outdone(f, g) for g in out)]

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans_ = texts(batch), batch.column(2)
            for a, b in slices(column):
                data, bounds = raw(column.slice(a, b - a))
                starts, ends = word_spans(data, bounds, _OUTSIDE[data])
                at = per_text(starts, bounds)
                whole = data.tobytes().translate(_LOWER)
                found = []
                for i, s in enumerate(spans_.slice(a, b - a).to_pylist()):
                    mine = slice(at[i], at[i + 1])
                    found.append(verify([whole[x:y].decode() for x, y in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)], s) if s else [])
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(found, kind)], ["row", "n_words", "found"])

    return met.mapInArrow(work, with_row(met, f"n_words long, found {FOUND}")).select(*named_apart("row", columns, ("n_words", "found")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )
