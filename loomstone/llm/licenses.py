"""License scans by diagonal voting.

Rolling hashes of k words meet the positions of the same hashes in the license
templates; hits of one document and template vote for their offset (document
position less template position), neighbouring offsets are merged, so that a
word more or less does not break a span.  A span is verified by alignment: the
template's positions that it holds in the template's order must be most of the
template, within little more than its length, and the words that tell licences
apart must be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.native import ascii_lower, let, split_words
from loomstone.runtime import persist_table

#: What lies between words (a character class body, after A-Z are lower-cased).
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

#: Phrases that decide alone: phrase -> label (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Grant texts as they stand in files: label -> words (fixed values).
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
        "this project is licensed under the terms of the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "licensed under the apache license version 2 0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by-nd": [
        "licensed under cc by nd 4 0",
        "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    ],
    "cc-by-nc-sa": [
        "licensed under cc by nc sa 4 0",
        "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    ],
    "cc-by-nc-nd": [
        "licensed under cc by nc nd 4 0",
        "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    ],
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
    ],
    "gpl-2": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version",
        "licensed under the gnu general public license version 2",
        "this work is licensed under the gnu general public license version 2",
    ],
    "lgpl-2.1": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation either version 2 1 of the license or at your option any later "
        "version",
        "licensed under the gnu lesser general public license version 2 1",
    ],
    "lgpl-3": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
        "licensed under the gnu lesser general public license version 3",
    ],
    "agpl-3": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
        "licensed under the gnu affero general public license version 3",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ],
    "bsd-2-clause": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution this software is provided by the "
        "copyright holders and contributors as is",
    ],
    "bsd-3-clause": [
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "epl-2": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which "
        "is available at https www eclipse org legal epl 2 0",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "licensed under cc0 1 0 universal",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
        "sell or distribute this software",
    ],
}
#: Words that tell a licence from its near relatives: each that a template holds must stand in a span (GRAM words at most).
KEYS = [
    "gnu general", "gnu lesser general", "gnu affero general", "license version 2", "license version 3", "either version 2",
    "either version 3", "version 2 1", "version 2 of", "version 3 of", "mit license", "distribution this software", "eclipse public", "cc0 1",
    "apache license", "mozilla public", "by 4 0", "by nc 4", "by sa 4", "by nd 4", "by nc sa", "nc sa 4", "by nc nd", "nc nd 4",
    "attribution 4", "attribution noncommercial 4", "attribution sharealike 4", "attribution noderivatives 4",
    "attribution noncommercial sharealike", "noncommercial sharealike 4",
    "attribution noncommercial noderivatives", "noncommercial noderivatives 4",
]
GRAM = 3
#: Offsets that differ by at most this much are one diagonal.
DRIFT = 2
#: Share of a template's grams that a span must hold in order, and how long it may be, in lengths of the template, and words more.
COVER = 0.8
LONGEST, SLACK = 1.5, 2
#: So many grams of templates may be written into the plan and broadcast; with more, all grams of the texts are joined.
FEW_GRAMS = 20_000


def _gram(words: Column, at: Column, size: int = GRAM) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(size)))


def template_grams(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(template, label, grams, at, gram): every gram position of the templates, as many rows as they have words."""
    rows = [(i, label, t.split()) for i, (label, t) in enumerate((k, t) for k, ts in templates.items() for t in ts)]
    base = spark.createDataFrame(rows, "template int, label string, words array<string>")
    n = F.size("words") - (GRAM - 1)
    return base.select("template", "label", n.alias("grams"), "words", F.posexplode(F.sequence(F.lit(0), n - 1))).select(
        "template", "label", "grams", F.col("pos").alias("at"), _gram(F.col("words"), F.col("pos")).alias("gram")
    )


def key_grams(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(template, keys): for each of KEYS in a template the gram positions that hold it, a fixed small table."""
    rows = []
    for i, words in enumerate(t.split() for ts in templates.values() for t in ts):
        keys = []
        for key in (k.split() for k in KEYS):
            at = [j for j in range(len(words) - GRAM + 1) if any(words[j + x : j + x + len(key)] == key for x in range(GRAM - len(key) + 1))]
            keys += [at] if at else []
        rows.append((i, keys))
    return spark.createDataFrame(rows, "template int, keys array<array<int>>")


def _places(words: Column, text: Column, phrase: str) -> Column:
    """Word positions where the phrase stands; texts without its rarest words skip the search."""
    parts = phrase.split()
    hit = lambda i: _all(F.get(words, i + k) == p for k, p in enumerate(parts))
    none = F.array().cast("array<int>")
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), hit)
    return F.when((F.size(words) >= len(parts)) & text.contains(parts[-1]) & text.contains(parts[0]), found).otherwise(none)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row a document: doc_id, n_words, base, spans.

    base: array<struct<at, label>>, the places of the deciding phrases in words.
    spans: array<struct<first, last, label, cover, votes>>, verified template spans in
    words, by position; of spans that overlap, those with most votes.  Null and empty texts have neither.  Repeated rows are
    scanned each, a null doc_id stays, an empty table gives no rows.

    Hits are found where the words are and only they are shuffled, by row and
    template.  A caller's templates beyond FEW_GRAMS are neither collected nor broadcast.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    few = sum(len(t.split()) for ts in templates.values() for t in ts) <= FEW_GRAMS
    known = [r["gram"] for r in grams.select("gram").distinct().collect()] if few else []
    small = F.broadcast if few else lambda df: df
    rows = pick(docs, "doc_id", "text").select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))

    def facts(words: Column) -> Column:
        n = F.size(words)
        places = F.when(n >= GRAM, F.sequence(F.lit(0), n - GRAM)).otherwise(F.array().cast("array<int>"))
        all_grams = F.transform(places, lambda i: F.struct(i.alias("pos"), _gram(words, i).alias("gram")))
        base = [
            F.transform(_places(words, F.col("text"), p), _labelled(label)) for p, label in phrases.items()
        ]
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.array_sort(F.concat(*base)).alias("base"),
            (F.filter(all_grams, lambda g: g["gram"].isin(known)) if few else all_grams).alias("hits"),
        )

    found = rows.select("doc_id", let(split_words(F.col("text"), BETWEEN), facts).alias("f")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "f.n_words", "f.base", "f.hits"
    )
    found = persist_table(found, "license-hits")

    votes = (
        found.filter(F.size("hits") > 0)
        .select("row", F.explode("hits").alias("h"))
        .select("row", "h.pos", "h.gram")
        .join(small(grams), "gram")
        .select("row", "template", "label", "grams", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    # Diagonals in order; a step wider than DRIFT begins a new chain.
    along = Window.partitionBy("row", "template").orderBy("diagonal", "pos")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True)).cast("int")
    chains = (
        votes.withColumn("far", far)
        .withColumn("chain", F.sum("far").over(along))
        .groupBy("row", "template", "label", "grams", "chain")
        .agg(F.array_sort(F.collect_list(F.struct("at", "pos"))).alias("hits"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"))
    )
    spans = (
        chains.withColumn("held", _in_order(F.col("hits")))
        .withColumn("cover", F.size("held") / F.col("grams"))
        .filter(F.col("cover") >= COVER)
        .filter(F.col("last") - F.col("first") + 1 <= LONGEST * (F.col("grams") + GRAM - 1) + SLACK)
        .join(small(key_grams(spark, templates)), "template")
        .filter(F.forall("keys", lambda k: F.arrays_overlap(k, F.col("held"))))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "cover", F.size("held").alias("votes")))).alias("spans"))
    )
    # Templates that differ in a version number vote for one place; the one with most votes wins it.
    spans = spans.withColumn(
        "spans",
        F.filter(
            "spans",
            lambda a: ~F.exists(
                "spans", lambda b: (b["votes"] > a["votes"]) & (b["first"] <= a["last"]) & (a["first"] <= b["last"])
            ),
        ),
    )
    empty = F.array().cast("array<struct<first:int,last:int,label:string,cover:double,votes:int>>")
    return found.join(spans, "row", "left").select(
        "doc_id", "n_words", "base", F.coalesce("spans", empty).alias("spans")
    )


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def _in_order(hits: Column) -> Column:
    """The template positions of a chain, array<struct<at, pos>> by at, that stand in the text in the same order."""
    zero = F.struct(F.array().cast("array<int>").alias("ats"), F.lit(-1).alias("at"), F.lit(-1).alias("pos"))

    def step(a: Column, h: Column) -> Column:
        taken = F.struct(F.concat(a["ats"], F.array(h["at"])).alias("ats"), h["at"].alias("at"), h["pos"].alias("pos"))
        return F.when((h["at"] > a["at"]) & (h["pos"] > a["pos"]), taken).otherwise(a)

    return F.aggregate(hits, zero, step, lambda a: a["ats"])


def license_digest(docs: DataFrame) -> DataFrame:
    """Counts and labels of :func:`scan_licenses` per document; score is the best cover, 1 for a base phrase."""
    found = scan_licenses(docs)
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    more = F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)))
        .alias("score"),
    )
