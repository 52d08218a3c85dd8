"""License scans by ordered signature rules.

A rule is a keyword and a pattern that starts with it, over lower-cased words with one blank after each. Only
words that are the keyword of a rule are looked at: the keyword gates the pattern. Rules have a priority; a
detection that lies inside the words of one with the same or a better priority is suppressed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyledger.functions.steps import let, pinned
from storyledger.llm.text import words

REACH = 24  # words from the keyword on that a pattern may use


class Rule(NamedTuple):
    keyword: str
    pattern: str
    label: str
    priority: int  # 0 is the best
    confidence: float
    base: bool


# Phrases that are always labelled.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Names of licences as word patterns, with their numbered versions.
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("apache", ("apache (software )?(license|licence) ", "apache "), ("1.0", "1.1", "2.0")),
    ("gpl", ("gnu general public (license|licence) ", "gpl ", "gplv"), ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu (lesser|library) general public (license|licence) ", "lgpl ", "lgplv"), ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public (license|licence) ", "agpl ", "agplv"), ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation (license|licence) ", "gfdl "), ("1.1", "1.2", "1.3")),
    ("mpl", ("mozilla public (license|licence) ", "mpl "), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public (license|licence) ", "epl "), ("1.0", "2.0")),
    ("cddl", ("common development and distribution (license|licence) ", "cddl "), ("1.0", "1.1")),
    ("cpl", ("common public (license|licence) ",), ("0.5", "1.0")),
    ("eupl", ("european union public (license|licence) ", "eupl "), ("1.0", "1.1", "1.2")),
    ("cecill", ("cecill (free software )?((license|licence) )?",), ("1.0", "2.0", "2.1")),
    ("artistic", ("artistic (license|licence) ",), ("1.0", "2.0")),
    ("afl", ("academic free (license|licence) ", "afl "), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", ("open software (license|licence) ", "osl "), ("1.0", "2.0", "2.1", "3.0")),
    ("lppl", ("latex project public (license|licence) ", "lppl "), ("1.0", "1.1", "1.2", "1.3")),
    ("apsl", ("apple public source (license|licence) ", "apsl "), ("1.0", "1.1", "1.2", "2.0")),
    ("zpl", ("zope public (license|licence) ", "zpl "), ("1.1", "2.0", "2.1")),
    ("php", ("php (license|licence) ",), ("3.0", "3.01")),
    ("python", ("python software foundation (license|licence) ", "psf (license|licence) "), ("2.0",)),
    ("boost", ("boost software (license|licence) ", "bsl "), ("1.0",)),
    ("ofl", ("sil open font (license|licence) ", "ofl "), ("1.0", "1.1")),
    ("odbl", ("open database (license|licence) ", "odbl "), ("1.0",)),
    ("odc-by", ("open data commons attribution (license|licence) ",), ("1.0",)),
    ("pddl", ("public domain dedication and (license|licence) ", "pddl "), ("1.0",)),
    ("ms-pl", ("microsoft public (license|licence) ",), ()),
    ("ms-rl", ("microsoft reciprocal (license|licence) ",), ()),
    ("mit", ("mit (license|licence) ", "expat (license|licence) "), ()),
    ("x11", ("x11 (license|licence) ",), ()),
    ("isc", ("isc (license|licence) ",), ()),
    ("zlib", ("zlib (libpng )?(license|licence) ",), ()),
    ("ncsa", ("university of illinois ncsa open source (license|licence) ",), ()),
    ("postgresql", ("postgresql (license|licence) ",), ()),
    ("openssl", ("openssl (license|licence) ",), ()),
    ("ruby", ("ruby (license|licence) ",), ()),
    ("unlicense", ("unlicense ",), ()),
    ("wtfpl", ("do what the fuck you want to public (license|licence) ", "wtfpl "), ("1.0", "2.0")),
    ("bsd-2-clause", ("(bsd )?2 clause (bsd )?(license|licence) ", "simplified bsd (license|licence) "), ()),
    ("bsd-3-clause", ("(bsd )?3 clause (bsd )?(license|licence) ", "modified bsd (license|licence) ", "new bsd (license|licence) "), ()),
    ("bsd", ("bsd (style )?(license|licence) ",), ()),
    ("cc0", ("cc0 ", "creative commons zero "), ("1.0",)),
)
# Terms of the attribution licences: label, code, words of the full name.
ATTRIBUTION = (
    ("by", "by ", "attribution "),
    ("by-sa", "by sa ", "attribution share ?alike "),
    ("by-nd", "by nd ", "attribution no ?deriv(ative)?s? (works )?"),
    ("by-nc", "by nc ", "attribution non ?commercial "),
    ("by-nc-sa", "by nc sa ", "attribution non ?commercial share ?alike "),
    ("by-nc-nd", "by nc nd ", "attribution non ?commercial no ?deriv(ative)?s? (works )?"),
)
ATTRIBUTION_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Opening words of licence texts and notices, each with its label, priority and confidence.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy ", "mit-text", 0, 0.99),
    ("permission to use copy modify and or distribute this software for any purpose ", "isc-text", 0, 0.99),
    ("permission to use copy modify and distribute this software ", "permissive-text", 1, 0.9),
    ("redistribution and use in source and binary forms ", "bsd-text", 0, 0.99),
    ("redistributions of source code must retain the above copyright notice ", "bsd-text", 1, 0.9),
    ("redistributions in binary form must reproduce the above copyright notice ", "bsd-text", 1, 0.9),
    ("neither the name of ", "bsd-3-clause-text", 3, 0.4),
    ("this software is provided as is ", "warranty-disclaimer", 3, 0.5),
    ("this program is free software you can redistribute it and or modify it ", "gpl-text", 0, 0.99),
    ("this library is free software you can redistribute it and or modify it ", "lgpl-text", 0, 0.99),
    ("this source code form is subject to the terms of the mozilla public ", "mpl-text", 0, 0.99),
    ("this is free and unencumbered software released into the public domain ", "unlicense-text", 0, 0.99),
    ("unless required by applicable law or agreed to in writing ", "apache-text", 1, 0.8),
    ("everyone is permitted to copy and distribute verbatim ", "gnu-text", 1, 0.8),
    ("(dedicated|released) (in)?to the public domain ", "public-domain", 1, 0.8),
    ("this work is (in the|public) (public )?domain ", "public-domain", 1, 0.8),
    ("public domain ", "public-domain", 3, 0.4),
    ("all rights (are )?reserved ", "proprietary-notice", 2, 0.6),
    ("copyright (c )?[12][0-9]{3} ", "copyright-notice", 3, 0.5),
    ("confidential and proprietary ", "proprietary-notice", 2, 0.6),
    ("for non ?commercial use only ", "non-commercial", 2, 0.7),
    ("no derivatives? works? ", "no-derivatives", 3, 0.4),
)


def _version(number: str) -> str:
    major, minor = number.split(".")
    return rf"{major} ({minor} )?" if minor == "0" else rf"{major} {minor} "


def _starts(pattern: str) -> list[str]:
    """All words that a match of a pattern can start with; every group before its first blank is taken apart."""
    head, group, rest = re.match(r"([^(]*)(?:\(([^()]*)\)(.*))?$", pattern).groups()
    if group is None or " " in head:
        word = head.split(" ")[0]
        if not re.fullmatch("[a-z0-9]+", word):
            raise ValueError(f"no plain word to look up at the start of {pattern!r}")
        return [word]
    options = group.split("|") + ([""] if rest.startswith("?") else [])
    return sorted({word for option in options for word in _starts(head + option + rest.removeprefix("?"))})


def build_rules() -> list[Rule]:
    """All rules in order, from the tables above: notices, named versions, names, attribution terms, texts."""
    made: list[tuple[str, str, int, float, bool]] = [(f"{p} ", label, 9, 1.0, True) for p, label in BASE.items()]
    granted = r"(licensed|released|distributed|available|published) under (the |a |an )?(terms of (the )?|conditions of (the )?)?"
    version = r"(version |v |v)?"
    named = [(label, names, versions) for label, names, versions in FAMILIES]
    for code, short, long in ATTRIBUTION:
        named.append((f"cc-{code}", (f"cc {short}", f"creative commons {long}(international |unported )?((license|licence) )?"), ATTRIBUTION_VERSIONS))
    for label, names, versions in named:
        for name in names:
            for number in versions:
                # A name that ends in v has its number in the same word: gplv3.
                at = f"{name}{'' if name.endswith('v') else version}{_version(number)}"
                made.append((granted + at, f"{label}-{number}", 0, 0.98, False))
                made.append((at, f"{label}-{number}", 1, 0.9, False))
            made.append((granted + name, f"{label}-any", 1, 0.8, False))
            if name.count(" ") > 1:
                made.append((name, f"{label}-any", 2, 0.6, False))
    made += [(pattern, label, priority, confidence, False) for pattern, label, priority, confidence in TEXTS]
    rules = []
    for pattern, label, priority, confidence, base in made:
        for keyword in _starts(pattern):
            rules.append(Rule(keyword, f"^{pattern}", label, priority, confidence, base))
    return rules


RULES = build_rules()
KEYWORDS = sorted({r.keyword for r in RULES})
PRIORITIES = sorted({r.priority for r in RULES if not r.base})


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    numbered = [(i, *r) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        numbered, "rule int, keyword string, pattern string, label string, priority int, confidence double, base boolean"
    )


def anchors(tokens: Column, keywords: list[str]) -> Column:
    """Places of keywords with the words from there on; last, an empty one that stands for the text itself."""
    known = F.array(*[F.lit(k) for k in keywords])
    numbered = F.transform(tokens, lambda w, i: F.struct(i.alias("at"), w.alias("keyword")))
    gated = F.when(F.arrays_overlap(tokens, known), F.filter(numbered, lambda s: s["keyword"].isin(keywords)))
    seen = F.transform(
        F.coalesce(gated, F.array().cast("array<struct<at: int, keyword: string>>")),
        lambda s: F.struct(
            s["at"].alias("at"), s["keyword"].alias("keyword"),
            F.concat(F.array_join(F.slice(tokens, s["at"] + 1, F.lit(REACH)), " "), F.lit(" ")).alias("ahead"),
        ),
    )
    own = F.array(F.lit(None).cast("struct<at: int, keyword: string, ahead: string>"))
    return F.concat(seen.cast("array<struct<at: int, keyword: string, ahead: string>>"), own)


def detections(docs: DataFrame, keep: list[str], *, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``row``, ``keep``, ``n_words`` and a detection (``at``, ``stop``, rule columns, ``suppressed``) in each row.

    Every text also has one row without a detection, so no text is lost.
    """
    rules = RULES if rules is None else rules
    keywords = sorted({r.keyword for r in rules})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.col(text).alias("__text"))
    found = let(
        words(F.col("__text")),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), anchors(w, keywords).alias("anchors")),
    )
    each = pinned(rows, ["row", *keep], {"found": found}).select(
        "row", *keep, "found.n_words", F.explode("found.anchors").alias("anchor")
    )
    # The rules are a constant of this module or of the caller, far under 1 MB.
    tried = each.join(F.broadcast(rule_table(docs.sparkSession, rules)), F.col("anchor.keyword") == F.col("keyword"), "left")
    matched = tried.withColumn("match", F.expr("regexp_extract(anchor.ahead, pattern, 0)"))
    hits = matched.where("anchor is null or match <> ''").select(
        "row", *keep, "n_words", "rule", "label", "priority", "confidence", "base",
        F.col("anchor.at").cast("bigint").alias("at"),
        (F.col("anchor.at") + F.regexp_count("match", F.lit(" "))).cast("bigint").alias("stop"),
    )
    earlier = (
        Window.partitionBy("row")
        .orderBy(F.col("at"), F.col("stop").desc(), F.col("priority"), F.col("rule"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = {
        f"__reach{p}": F.max(F.when((F.col("priority") == p) & ~F.col("base"), F.col("stop"))).over(earlier)
        for p in sorted({r.priority for r in rules if not r.base})
    }
    covered = F.lit(False)
    for p in sorted({r.priority for r in rules if not r.base}):
        covered = covered | ((F.col("priority") >= p) & (F.coalesce(F.col(f"__reach{p}"), F.lit(-1)) >= F.col("stop")))
    return hits.withColumns(reached).withColumn("suppressed", covered & ~F.col("base")).drop(*reached)


def scan_licenses(docs: DataFrame, keep: list[str], *, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row for each text: ``keep``, ``n_words``, places and labels of base phrases, all labels, ``score``.

    ``score`` is the confidence of the best detection that stays, 0 without one. Null and empty texts have no
    words. Repeated rows each get their row.
    """
    base, kept = F.col("base"), ~F.col("base") & ~F.col("suppressed")
    joined = detections(docs, keep, text=text, rules=rules).groupBy("row").agg(
        *[F.first(c).alias(c) for c in keep],
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("at"))).alias("first_word"),
        F.max(F.when(base, F.col("at"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | kept, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | kept, F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    return joined.drop("row")
