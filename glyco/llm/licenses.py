"""License detection by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyco.llm.text import ascii_lower, whole

# Words are runs of 0-9, a-z and anything beyond ASCII, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases that always count, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Families as (label, names as patterns over single-spaced words, versions).
FAMILIES = (
    ("apache", ("apache(?: software)?", "asl"), ("1 0", "1 1", "2 0")),
    ("gpl", ("(?:gnu )?general public", "(?:gnu )?gpl"), ("1 0", "2 0", "3 0")),
    ("lgpl", ("(?:gnu )?(?:lesser|library) general public", "(?:gnu )?lgpl"), ("2 0", "2 1", "3 0")),
    ("agpl", ("(?:gnu )?affero general public", "(?:gnu )?agpl"), ("1 0", "3 0")),
    ("gfdl", ("(?:gnu )?free documentation", "gfdl"), ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public", "cpl"), ("1 0",)),
    ("ipl", ("ibm public",), ("1 0",)),
    ("eupl", ("european union public", "eupl"), ("1 0", "1 1", "1 2")),
    ("afl", ("academic free", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", ("open software", "osl"), ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", ("(?:perl )?artistic",), ("1 0", "2 0")),
    ("bsl", ("boost software",), ("1 0",)),
    ("busl", ("business source",), ("1 0", "1 1")),
    ("sspl", ("server side public",), ("1 0",)),
    ("elastic", ("elastic",), ("2 0",)),
    ("cc by", ("creative commons attribution", "cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by sa", ("creative commons attribution share ?alike", "cc by sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nc", ("creative commons attribution non ?commercial", "cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nd", ("creative commons attribution no ?deriv(?:ative)?s", "cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nc sa", ("creative commons attribution non ?commercial share ?alike", "cc by nc sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nc nd", ("creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("creative commons zero", "cc0"), ("1 0",)),
    ("cecill", ("cecill",), ("1 0", "1 1", "2 0", "2 1")),
    ("ecl", ("educational community",), ("1 0", "2 0")),
    ("ofl", ("(?:sil )?open font", "ofl"), ("1 0", "1 1")),
    ("lppl", ("latex project public", "lppl"), ("1 0", "1 1", "1 2", "1 3")),
    ("mulan", ("mulan(?: permissive software| psl)?",), ("1 0", "2 0")),
    ("odbl", ("open (?:data commons open )?database", "odbl"), ("1 0",)),
    ("php", ("php",), ("3 0", "3 01")),
    ("python", ("python(?: software foundation)?", "psf"), ("2 0", "2 1")),
    ("qpl", ("q public", "qpl"), ("1 0",)),
    ("upl", ("universal permissive",), ("1 0",)),
    ("zpl", ("zope public", "zpl"), ("1 1", "2 0", "2 1")),
    ("ms pl", ("microsoft public", "ms pl"), ("1 0",)),
    ("ms rl", ("microsoft reciprocal", "ms rl"), ("1 0",)),
    ("mit", ("mit", "expat", "mit x11"), ()),
    ("x11", ("x11", "x consortium"), ()),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("bsd 2 clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), ()),
    ("bsd 3 clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), ()),
    ("bsd 4 clause", ("bsd 4 clause", "4 clause bsd", "original bsd"), ()),
    ("bsd", ("berkeley software distribution", "bsd"), ()),
    ("ncsa", ("(?:university of illinois )?ncsa(?: open source)?",), ()),
    ("openssl", ("openssl", "ssleay"), ()),
    ("postgresql", ("postgresql",), ()),
    ("ruby", ("ruby",), ()),
    ("sleepycat", ("sleepycat",), ()),
    ("vim", ("vim",), ()),
    ("w3c", ("w3c(?: software)?(?: notice and)?",), ()),
    ("json", ("json",), ()),
    ("beerware", ("beer ?ware",), ()),
    ("blue oak", ("blue oak model",), ()),
)
# Signatures that stand alone, as (label, priority, keyword, pattern).
SIGNATURES = (
    ("mit", 3, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 3, "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd 3 clause", 3, "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("zlib", 3, "altered", "altered source versions must be plainly marked as such"),
    ("unlicense", 3, "unencumbered", "free and unencumbered software released into the public domain"),
    ("unlicense", 1, "unlicense", "(?:the )?unlicense"),
    ("wtfpl", 2, "wtfpl", "wtfpl"),
    ("cc0", 3, "affirmer", "affirmer (?:hereby )?(?:overtly )?fully permanently irrevocably"),
    ("public domain", 1, "domain", "(?:in|into|to) the public domain"),
    ("proprietary", 1, "reserved", "all rights reserved"),
    ("proprietary", 2, "confidential", "proprietary and confidential"),
    ("gpl", 3, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 2, "foundation", "published by the free software foundation"),
    ("apache", 3, "compliance", "you may not use this file except in compliance with the license"),
    ("mpl", 3, "subject", "this source code form is subject to the terms of the mozilla public license"),
    ("sspl", 2, "sspl", "sspl"),
    ("noncommercial", 1, "commercial", "(?:for )?non ?commercial use only"),
)
LEVELS = 4  # priorities 0 to 3
RULE_TABLE = "array<struct<first:string, second:string, rules:array<struct<rule:int, label:string, priority:int, pattern:string>>>>"


def literal(pattern: str) -> str:
    """The longest text that every match of a name pattern holds."""
    fixed = re.sub(r"\(\?:[^()]*\)\?", "|", pattern)  # optional groups
    fixed = re.sub(r"\(\?:[^()]*\)|.\?", "|", fixed)  # alternatives and optional letters
    return max((part.strip() for part in fixed.split("|")), key=len)


def rules() -> list[tuple[str, int, str, str, str]]:
    """(label, priority, keyword, second keyword, pattern), most specific forms first.

    Each family name gives its bare license name, the notice that grants it, its identifier tag, and all
    of them with each version. Both keywords are substrings of every text that the pattern matches.
    """
    made = [(label, priority, keyword, keyword, pattern) for label, priority, keyword, pattern in SIGNATURES]
    for label, names, versions in FAMILIES:
        for name in names:
            key, called = literal(name), f"{name}(?: public)? licen[cs]e"
            made.append((label, 0, "licen", key, called))
            made.append((label, 2, "licen", key, f"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{called}"))
            made.append((label, 3, "spdx", key, f"spdx license identifier {name}"))
            for v in versions:
                major, minor = v.split(" ")
                number = f"{major}(?: {minor})?" if minor == "0" else v
                labelled = f"{label} {v}"
                made.append((labelled, 1, "licen", key, f"{called}(?: version| v)? {number}"))
                made.append((labelled, 2, "licen", key, f"licen[cs]ed under (?:the )?{called}(?: version| v)? {number}"))
                made.append((labelled, 3, "spdx", key, f"spdx license identifier {name} {number}"))
    return made


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """(start, end) in words of every match of a pattern in `` w0 w1 ... ``."""
    bound = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    gaps, hits = F.split(words, bound, -1), F.regexp_extract_all(words, bound, F.lit(0))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    begin = F.struct(F.lit(-1).alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + _spaces(x["gap"])
        end = start + _spaces(x["hit"])
        return F.struct(end.alias("at"), F.array_append(state["found"], F.struct(start.alias("start"), (end + 1).alias("end"))).alias("found"))

    return F.when(F.rlike(words, bound), F.aggregate(steps, begin, step, lambda s: s["found"])).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the base phrases, first_word and last_word are the smallest and largest
    of their first words (null without any). The rules run on texts that hold one of their keywords, each
    rule only where its own keyword stands. A detection is suppressed if it lies inside another of higher
    priority, or of the same priority and at least its length; ``labels`` names what is left and the base
    labels, ``score`` is the share of words inside what is left or inside base phrases. Null and empty
    texts have no words, no labels and score 0; repeated rows get equal answers; an empty table gives no
    rows; other columns are ignored.
    """
    table = [(label, LEVELS - 1, "licen", phrase, phrase) for phrase, label in BASE] + rules()
    base = len(BASE)
    text = docs.select("doc_id", "text", F.lower(whole(F.col("text"))).alias("low"))
    keywords = sorted({k for _, _, k, _, _ in table})
    gate = F.contains("low", F.lit(keywords[0]))
    for k in keywords[1:]:
        gate = gate | F.contains("low", F.lit(k))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.col("text")), NOT_WORD, " ")), F.lit(" "))
    sized = text.select("doc_id", F.regexp_count(whole(F.col("text")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.when(gate, words).alias("words"))
    # Rules with the same keywords stand together, so that a text is searched for each keyword once.
    groups: dict[tuple[str, str], list] = {}
    for i, (label, priority, first, second, pattern) in enumerate(table):
        groups.setdefault((first, second), []).append({"rule": i, "label": label, "priority": priority, "pattern": pattern})
    text_form = json.dumps([{"first": a, "second": b, "rules": r} for (a, b), r in groups.items()])
    listed = F.from_json(F.lit(text_form), RULE_TABLE)  # folded into a constant
    gated = F.flatten(F.filter(listed, lambda g: F.contains(F.col("words"), g["first"]) & F.contains(F.col("words"), g["second"]))["rules"])
    found = F.flatten(F.transform(gated, lambda r: F.transform(_places(F.col("words"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("end"), (-r["priority"]).alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))))
    hits = sized.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), F.sort_array(found)).alias("hits"))
    own = F.coalesce(F.filter("hits", lambda h: h["rule"] < base), F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>"))
    begin = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("to"), F.lit(0).alias("covered"))

    def step(state: Column, h: Column) -> Column:
        end, level = -h["end"], -h["priority"]
        inside = F.exists(F.slice(state["ends"], level + 1, F.lit(LEVELS)), lambda e: e >= end)
        drop = inside & (h["rule"] >= base)
        ends = F.transform(state["ends"], lambda e, i: F.when(i == level, F.greatest(e, end)).otherwise(e))
        new = F.greatest(F.lit(0), end - F.greatest(h["start"], state["to"]))
        return F.struct(
            ends.alias("ends"),
            F.when(drop, state["labels"]).otherwise(F.array_union(state["labels"], F.array(h["label"]))).alias("labels"),
            F.when(drop, state["to"]).otherwise(F.greatest(state["to"], end)).alias("to"),
            F.when(drop, state["covered"]).otherwise(state["covered"] + new).alias("covered"),
        )

    told = hits.withColumn("kept", F.aggregate(F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")), begin, step)).withColumn("own", own)
    return told.select(
        "doc_id",
        "n_words",
        F.size("own").cast("long").alias("n_base"),
        F.array_min(F.col("own.start")).cast("long").alias("first_word"),
        F.array_max(F.col("own.start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("own.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort("kept.labels"), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.col("kept.covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
