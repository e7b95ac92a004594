"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, lower_ascii, stored

#: Phrases whose places are reported, with their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Usual notices and whole license texts as words, with the label that a text containing one gets (fixed values).
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1 0"),
]

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9


def block_words(template: str) -> int:
    """How many consecutive words of a text are a block for this template: its own number and a quarter more."""
    return math.ceil(1.25 * len(template.split()) - 1e-9)


def _clean(text):
    """Words of a text joined by one blank; line ends stay."""
    return F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _words(line):
    """The words of a cleaned text: lines and blanks part them."""
    return F.filter(F.split(line, "[ \n]+"), lambda w: w != "")


def template_index(templates: list[tuple[str, str]], ranks: dict[str, int], containment: float) -> list[dict]:
    """One entry for each token of each template's prefix.

    A block that holds `need` of a template's n distinct tokens holds one of the n - need + 1 rarest; `at` counts that
    token's place in the template's order from 1.
    """
    out = []
    for number, (_, text) in enumerate(templates):
        tokens = sorted(ranks[w] for w in set(text.split()))
        need = math.ceil(containment * len(tokens) - 1e-9)
        out += [{"token": t, "template": number, "tokens": tokens, "need": need, "at": i + 1, "wide": block_words(text)} for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    return out


def token_ranks(words: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Template words ordered by the number of texts of the whole corpus, words(words), that hold them, rarest first.

    The counts are partial before the shuffle and at most as many as the templates have words: only they reach the driver.
    """
    names = sorted({w for _, text in templates for w in text.split()})
    counts = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, names)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counts.collect()}
    return {w: i for i, w in enumerate(sorted(names, key=lambda w: (found.get(w, 0), w)))}


def known_places(words, ranks: dict[str, int], templates: list[tuple[str, str]], containment: float):
    """Place and rank of each template word in an array of words, in order; none for texts without any word of a
    template's prefix, which hold no block."""
    names = sorted(ranks, key=ranks.__getitem__)
    prefixes = sorted({names[e["token"]] for e in template_index(templates, ranks, containment)})
    rank = lambda w: F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), w)
    own = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("p"), F.when(w.isin(*names), rank(w)).alias("r"))), lambda x: x["r"].isNotNull())
    none = F.expr("array()").cast("array<struct<p:int,r:int>>")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, prefixes))), own).otherwise(none)


def template_matches(hits: DataFrame, ranks: dict[str, int], templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """__key, template, s and found of every block of hits(__key, hits: known_places) that holds at least `containment` of a template's
    distinct words: the place of its first template word, and how many it holds.

    A block is block_words() consecutive words that begin with a word of the template. Prefix filter: a qualifying block and
    template share a token of the template's prefix, so blocks are sought around these only, once for each stretch of
    a block's length. Length filter: that stretch and its neighbours have as many template words as a block must hold.
    Positional filter: the tokens after the shared one must suffice on both sides. Each block that is left is verified by
    its overlap. The join's other side is the template index, whose size the templates fix.
    """
    spark = hits.sparkSession
    entries = template_index(templates, ranks, containment)
    index = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(entries)), "array<struct<token:int,template:int,tokens:array<int>,need:int,at:int,wide:int>>")))
    prefix = F.array(*map(F.lit, sorted({e["token"] for e in entries})))
    probes = hits.select("__key", "hits", F.explode(F.array_distinct(F.transform(F.filter("hits", lambda x: F.array_contains(prefix, x["r"])), lambda x: x["r"]))).alias("token"))
    met = probes.join(F.broadcast(index), "token")
    stretches = F.array_distinct(F.transform(F.filter("hits", lambda x: x["r"] == F.col("token")), lambda x: F.floor(x["p"] / F.col("wide")).cast("int")))
    met = met.select("*", F.explode(stretches).alias("stretch"))
    low, high = (F.col("stretch") - 1) * F.col("wide"), (F.col("stretch") + 2) * F.col("wide")
    near = F.filter("hits", lambda x: (x["p"] >= low) & (x["p"] < high) & F.array_contains("tokens", x["r"]))
    met = met.select("__key", "template", "need", "at", "wide", "token", F.size("tokens").alias("n"), near.alias("near"))
    own = F.array_sort(F.array_distinct(F.transform("near", lambda x: x["r"])))
    met = met.withColumn("own", own).where(F.size("own") >= F.col("need"))
    met = met.where(F.lit(1) + F.least(F.col("n") - F.col("at"), F.size("own") - F.array_position("own", F.col("token"))) >= F.col("need"))
    held = lambda x: F.size(F.array_distinct(F.transform(F.filter("near", lambda y: (y["p"] >= x["p"]) & (y["p"] < x["p"] + F.col("wide"))), lambda y: y["r"])))
    blocks = F.filter(F.transform("near", lambda x: F.struct(x["p"].alias("s"), held(x).alias("found"))), lambda x: x["found"] >= F.col("need"))
    met = met.select("__key", "template", F.inline(blocks))
    return met.groupBy("__key", "template", "s").agg(F.max("found").alias("found"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs(doc_id, text).

    Base: places of PHRASES, word by word, in the whole text; words are runs of digits, a-z and characters beyond ASCII
    after lower-casing A-Z. labels adds those of templates that a block of the text contains (template_matches), wherever
    its lines break, unless the block overlaps one of a template with all their words and more (CC BY in CC BY-NC). score
    is the largest containment of a template that gives a label, 0 without one; places of phrases don't count in it.

    A null text has no words. Repeated rows each get their result; rows of equal doc_id and different text are kept
    apart. An empty table gives an empty one. Other columns are ignored, whatever their names. Texts of any length are read
    whole. Texts are read twice, once for the rarity of words and once for places, which are stored; texts are never
    shuffled, only blocks, a few numbers each.
    """
    rows = keyed(docs.select("doc_id", "text"), "doc_id", "text")
    base = rows.select("doc_id", "__key", _words(_clean(F.col("text"))).alias("words"))
    ranks = token_ranks(base, templates)
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    hits = known_places(F.col("words"), ranks, templates, containment)
    base = base.select("doc_id", "__key", hits.alias("hits"), F.size("words").cast("long").alias("n_words"), F.when(spaced.rlike(f" ({'|'.join(PHRASES)}) "), F.col("words")).alias("words"))

    def places(phrase: str):
        parts = phrase.split()

        def here(i):
            test = F.get(F.col("words"), i) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                test = test & (F.coalesce(F.get(F.col("words"), i + k), F.lit("")) == w)
            return test

        return F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)

    base = base.select("doc_id", "__key", "hits", "n_words", F.when(F.col("words").isNotNull(), F.array(*[F.struct(F.lit(label).alias("label"), places(p).alias("at")) for p, label in PHRASES.items()])).alias("places"))
    at = F.flatten(F.transform("places", lambda x: x["at"]))
    labels = F.coalesce(F.transform(F.filter("places", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]), F.expr("array()").cast("array<string>"))
    base = stored(base.select("doc_id", "__key", "hits", "n_words", at.alias("at"), labels.alias("base")), "scanned")

    sizes = [len(set(t.split())) for _, t in templates]
    wider = [[j for j, (_, y) in enumerate(templates) if set(x.split()) < set(y.split())] for _, x in templates]
    pick = lambda values, kind, i: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), i + 1)
    matched = template_matches(base.where(F.size("hits") > 0).dropDuplicates(["__key"]), ranks, templates, containment)
    matched = matched.groupBy("__key").agg(F.collect_list(F.struct("template", "s", "found", pick([block_words(t) for _, t in templates], "int", F.col("template")).alias("wide"))).alias("met"))
    over = lambda m: F.element_at(F.array(*[F.array(*map(F.lit, w)).cast("array<int>") for w in wider]), m["template"] + 1)
    hidden = lambda m: F.exists("met", lambda o: F.array_contains(over(m), o["template"]) & (o["s"] < m["s"] + m["wide"]) & (m["s"] < o["s"] + o["wide"]))
    matched = matched.select("__key", F.explode(F.filter("met", lambda m: ~hidden(m))).alias("m"))
    matched = matched.groupBy("__key").agg(F.collect_set(pick([label for label, _ in templates], "string", F.col("m.template"))).alias("found"), F.max(F.col("m.found") / pick(sizes, "int", F.col("m.template"))).alias("best"))

    out = base.join(matched, "__key", "left")
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        "doc_id", "n_words", F.coalesce(F.size(F.coalesce("at", F.expr("array()").cast("array<int>"))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("found", F.expr("array()").cast("array<string>")))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )
