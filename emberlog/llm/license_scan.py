"""License scans by diagonal voting.

Rolling word k-gram hashes of every text are joined with the positions of the
same grams in templates. Hits of one template on one diagonal (text position less template
position) vote for an alignment; neighbouring diagonals of long templates are merged, so that a
lost or added word does not break a span, and spans are verified by their cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, documents, grams, hashes_of, in_batches, slices, text_buffer, word_counts, words_of

#: phrases: every place counts; label
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: notices as they stand in source files and pages; label
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
]
PHRASE_K, NOTICE_K = 2, 4
SHIFT = 3  # diagonals this near are one alignment
COVER = 0.5  # least share of a notice's grams in a verified span


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]), ALNUM)
    return hashes_of(data, starts, ends)


def _template_grams(phrases=None, notices=None):
    rows = []
    for t, (label, text, k, base) in enumerate([(v, p, PHRASE_K, True) for p, v in (phrases or PHRASES).items()] + [(v, p, NOTICE_K, False) for v, p in (notices or NOTICES)]):
        h = _hashes(text)
        g, at = grams(h, np.zeros(len(h), np.int64), k)
        rows += [(t, label, base, len(g), len(h), k, int(x.astype(np.int64)), int(p)) for x, p in zip(g, at, strict=True)]
    return rows


TEMPLATE_SCHEMA = "template int, label string, base boolean, n_grams int, n_template int, k int, gram long, tpos long"


def license_hits(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with its counts, labels and spans.

    row: a number of the row; doc_id; n_words; spans array<struct<label, base, start,
    end, cover>>, words from 0. Null or empty text: no words, no spans. A text of any length is read whole. Repeated rows and equal or null
    doc_ids each give a row. Other columns play no part.
    """
    spark = docs.sparkSession
    rows = _template_grams()
    # a bitmap of the templates' grams, so that only possible join partners leave the scan
    filters = {}
    for k in (PHRASE_K, NOTICE_K):
        bits = np.zeros(1 << 20, bool)
        bits[[r[6] & 0xFFFFF for r in rows if r[5] == k]] = True
        filters[k] = bits

    def scan(batches):
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                data, off = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, owner = words_of(data, off, ALNUM)
                h = hashes_of(data, starts, ends)
                first = np.searchsorted(owner, np.arange(part.num_rows))
                n = word_counts(owner, part.num_rows)
                at_row, at_k, at_gram, at_pos = [np.arange(part.num_rows)], [np.zeros(part.num_rows, np.int32)], [np.zeros(part.num_rows, np.int64)], [np.zeros(part.num_rows, np.int64)]
                for k, bits in filters.items():
                    g, i = grams(h, owner, k)
                    hit = bits[(g & np.uint64(0xFFFFF)).astype(np.int64)]
                    g, i = g[hit], i[hit]
                    at_row.append(owner[i])
                    at_k.append(np.full(len(i), k, np.int32))
                    at_gram.append(g.astype(np.int64))
                    at_pos.append(i - first[owner[i]])
                r = np.concatenate(at_row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base + r), part.column("doc_id").take(pa.array(r)), pa.array(n[r]), pa.array(np.concatenate(at_k)), pa.array(np.concatenate(at_gram)), pa.array(np.concatenate(at_pos))],
                    ["row", "doc_id", "n_words", "k", "gram", "pos"],
                )
                base += part.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = in_batches(docs).select("doc_id", "text").mapInArrow(scan, f"row long, doc_id {kind}, n_words long, k int, gram long, pos long")
    templates = spark.createDataFrame(rows, TEMPLATE_SCHEMA)
    hits = scanned.join(F.broadcast(templates), ["k", "gram"], "left").repartition("row")
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "n_grams", "n_template"]
    diagonals = hits.groupBy(*keys, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("tpos").alias("votes"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("k")).alias("hi")
    )
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(w) > SHIFT)
    merged = (
        diagonals.select("*", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w).alias("group"))
        .groupBy(*keys, "group")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("start"), F.max("hi").alias("end"))
    )
    cover = F.least(F.col("votes") / F.col("n_grams"), F.lit(1.0))
    # a phrase needs all of its grams, a notice a share of them in a span of about its length
    whole = F.when(F.col("base"), F.col("votes") == F.col("n_grams")).otherwise(
        (cover >= COVER) & (F.col("end") - F.col("start") <= 2 * F.col("n_template"))
    )
    span = F.when(whole, F.struct("start", "end", "label", "base", cover.alias("cover")))
    return merged.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score: the largest cover of a verified span, 0 without any. See license_hits for nulls and repeats.
    """
    spans = license_hits(docs)
    base = F.filter("spans", lambda s: s["base"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        join(base).alias("base_labels"), join(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir, "doc_id", "text"))
