"""License scans: ordered signature rules behind a keyword prefilter, DataFrame operations only.

A text's words (ASCII letters, digits and everything beyond ASCII, lower case) are joined by single blanks, so that rules see one
normal form.  Only texts with a keyword are normalised and scanned; a rule is tried only where its own keyword stands.
Detections inside a longer or more important one are suppressed.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.session import materialize

#: The contract's phrases; all places count.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Hand-written rules, (label, keyword, pattern) over normalised text, most specific names first.  Patterns match whole words.
FAMILIES: list[tuple[str, str, str]] = [
    ("agpl-3.0", "affero", r"gnu affero general public license(?: v(?:ersion)? ?3(?: 0)?)?"),
    ("agpl-1.0", "affero", r"affero general public license v(?:ersion)? ?1(?: 0)?"),
    ("lgpl-2.0", "lesser", r"gnu (?:library|lesser) general public license v(?:ersion)? ?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license v(?:ersion)? ?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license v(?:ersion)? ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-library", "library", r"gnu library general public license"),
    ("gpl-1.0", "gnu", r"gnu general public license v(?:ersion)? ?1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu general public license v(?:ersion)? ?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public license v(?:ersion)? ?3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public license"),
    ("gpl", "gnu", r"gnu gpl(?: v ?[123])?"),
    ("gfdl", "gnu", r"gnu free documentation license(?: v(?:ersion)? ?1(?: [123])?)?"),
    ("apache-1.0", "apache", r"apache (?:software )?license v(?:ersion)? ?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license v(?:ersion)? ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license v(?:ersion)? ?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mit-0", "mit", r"mit no attribution(?: license)?"),
    ("x11", "x11", r"x11 license"),
    ("isc", "isc", r"isc license"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd license|bsd 2 clause(?: license)?|2 clause bsd(?: license)?)"),
    ("bsd-2-clause", "freebsd", r"freebsd license"),
    ("bsd-3-clause", "bsd", r"(?:new bsd license|modified bsd license|revised bsd license|bsd 3 clause(?: license)?|3 clause bsd(?: license)?)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd license|bsd 4 clause(?: license)?|4 clause bsd(?: license)?)"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?"),
    ("bsd", "bsd", r"bsd (?:style )?license"),
    ("mpl-1.0", "mozilla", r"mozilla public license v(?:ersion)? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license v(?:ersion)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license v(?:ersion)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license v(?:ersion)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license v(?:ersion)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl-1.0", "cddl", r"cddl(?: v(?:ersion)?)? ?1 0"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl-1.0", "license", r"common public license"),
    ("eupl", "union", r"european union public licen[cs]e(?: v(?:ersion)? ?1(?: [012])?)?"),
    ("artistic-2.0", "artistic", r"artistic license (?:v(?:ersion)? ?)?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("busl-1.1", "business", r"business source license(?: v(?:ersion)?)?(?: ?1 1)?"),
    ("sspl-1.0", "server", r"server side public license(?: v(?:ersion)? ?1)?"),
    ("elastic-2.0", "elastic", r"elastic license(?: v(?:ersion)?)?(?: ?2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want", r"do what the \w+ you want to public license"),
    ("python-2.0", "python", r"python (?:software foundation )?license"),
    ("php-3.01", "php", r"php license(?: v(?:ersion)? ?3(?: 0?1)?)?"),
    ("ruby", "ruby", r"ruby license"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("afl-3.0", "academic", r"academic free license(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("osl-3.0", "open", r"open software license(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ofl-1.1", "sil", r"sil open font license(?: v(?:ersion)? ?1(?: 1)?)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license"),
    ("odc-by-1.0", "commons", r"open data commons attribution license"),
    ("pddl-1.0", "domain", r"public domain dedication (?:and|&) license"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: free software)?(?: license)?(?: agreement)?"),
    ("vim", "vim", r"vim license"),
    ("json", "json", r"json license"),
    ("qpl-1.0", "public", r"q public license"),
    ("ipl-1.0", "ibm", r"ibm public license"),
    ("apsl-2.0", "apple", r"apple public source license"),
    ("npl-1.1", "netscape", r"netscape public license"),
    ("sleepycat", "sleepycat", r"sleepycat license"),
    ("upl-1.0", "universal", r"universal permissive license"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software|psl)(?: license)?"),
    ("blueoak-1.0", "oak", r"blue oak model license"),
    ("openrail", "rail", r"(?:open |creativeml open )?(?:rail|rail m) license"),
    ("llama", "llama", r"llama (?:\d )?community license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "domain", r"(?:released into|dedicated to|in) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|license|software)"),
    ("no-warranty", "warranty", r"(?:without warranty of any kind|without any warranty|as is without warranty)"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]
_SOFTWARE = r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_SHARED = r"redistribution and use in source and binary forms with or without modification are permitted"
_TERMS = r"redistribute it and or modify it under the terms of the gnu"
_ISSUED = r"(?: v(?:ersion)? ?[123](?: \d)?)? (?:of the license )?as published by the free software foundation"
#: Sentences that stand in a license's own text or in its standard file header; they name no license, or do so within a longer grant.
#: Where one grant begins like another, the longer pattern wins by containment.
BODIES: list[tuple[str, str, str]] = [
    ("mit", "hereby", _SOFTWARE),
    ("mit", "furnished", r"to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-0", "furnished", _SOFTWARE + r"(?: [^ ]+){10,50}? furnished to do so the software is provided"),
    ("ncsa", "hereby", _SOFTWARE + r"(?: [^ ]+){0,3} to deal with the software without restriction"),
    ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl-1.1", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)? (?:without fee is hereby granted|is hereby granted without fee)"),
    ("curl", "hereby", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution", _SHARED),
    ("bsd-3-clause", "endorse", r"neither the names? (?:of )?(?:[^ ]+ ){1,12}?(?:nor the names of (?:its|any|the) contributors )?may be used to endorse or promote products derived"),
    ("bsd-3-clause", "endorse", r"the names? of (?:[^ ]+ ){1,8}?may not be used to endorse or promote products derived"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", "redistribution", _SHARED + r"(?: [^ ]+){60,160}? patent license"),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:[^ ]+ ){1,10}?shall not be used in advertising or otherwise to promote the sale"),
    ("apache-2.0", "compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "redistribute", _TERMS + r" general public license" + _ISSUED),
    ("gpl-2.0", "redistribute", _TERMS + r" general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "redistribute", _TERMS + r" general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "redistribute", _TERMS + r" (?:lesser|library) general public license" + _ISSUED),
    ("lgpl-2.0", "redistribute", _TERMS + r" (?:lesser|library) general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "redistribute", _TERMS + r" (?:lesser|library) general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "redistribute", _TERMS + r" lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "redistribute", _TERMS + r" affero general public license" + _ISSUED + r"(?: either version 3 of the license)?"),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "freedom", r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl-2.1", "lesser", r"this license the lesser general public license applies to some specially designated software packages typically libraries"),
    ("lgpl-3.0", "lesser", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "affero", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license(?: [^ ]+){0,6} cddl"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0-1.0", "neighboring", r"(?:has )?(?:dedicated|waived) all copyright and related (?:or|and) neighboring rights"),
    ("cc-by", "attribution", r"bound by the terms and conditions of this creative commons attribution(?: \d \d)? international public license"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php-3.01", "php", r"this product includes php software"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"if we meet some ?day and you think this stuff is worth it you can buy me a beer in return"),
    ("ms-pl", "infringed", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("artistic", "artistic", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "artistic", r"the copyright holder maintains some artistic control over the development of that package"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:c )?(?:[^ ]+ )?the freetype project"),
]
#: Creative Commons terms; every term has short and long names, and versions.
CC_TERMS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Ways to name a license in a notice: what stands before the family's pattern raises its priority.
NOTICES = [
    r"(?:is |are )?(?:licensed|released|distributed|published|available|covered|provided) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?",
    r"(?:see|read) (?:the )?(?:file )?(?:license |licence |copying )?(?:for |under )?(?:the )?",
    r"(?:under the terms of|subject to the terms of|in accordance with) (?:the )?",
]
#: Names that short identifier lines use.
SPDX = [
    "mit", "isc", "0bsd", "zlib", "x11", "ncsa", "unlicense", "wtfpl", "apache 2 0", "apache 1 1", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause",
    "gpl 1 0", "gpl 2 0", "gpl 3 0", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0",
    "eupl 1 2", "artistic 2 0", "bsl 1 0", "busl 1 1", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "ofl 1 1", "postgresql", "openssl",
]

IDENTIFIER, NOTICE, NAME, HINT = 4, 3, 2, 1
CONFIDENCE = {IDENTIFIER: 1.0, NOTICE: 0.95, NAME: 0.8, HINT: 0.4}
_HINTS = {"all-rights-reserved", "proprietary", "no-warranty", "copyright", "public-domain"}


def rule_rows() -> list[tuple[str, str, str, int]]:
    """All rules in order: (keyword, pattern, label, priority)."""
    named = [(k, p, label, HINT if label in _HINTS else NAME) for label, k, p in FAMILIES]
    for term, spoken in CC_TERMS.items():
        short = "cc " + term.replace("-", " ")
        for version in CC_VERSIONS:
            label = f"cc-{term}-{version.replace(' ', '.')}"
            named.append(("cc", rf"{short} {version}", label, NAME))
            named.append(("creative", rf"creative commons {spoken}(?: international| unported)?(?: license)?(?: v(?:ersion)?)? ?{version}", label, NAME))
        named.append(("cc", rf"{short}(?! (?:sa|nd|nc)\b)", f"cc-{term}", NAME))
        named.append(("creative", rf"creative commons {spoken}(?! (?:non|no|share))", f"cc-{term}", NAME))
    notices = [(k, rf"{n}{p}", label, NOTICE) for k, p, label, kind in named if kind == NAME for n in NOTICES]
    spdx = [("spdx", rf"spdx license identifier {s}(?: only| or later)?", spelled(s), IDENTIFIER) for s in SPDX]
    # A license's own words are as sure as a notice.
    bodies = [(k, p, label, NOTICE) for label, k, p in BODIES]
    return [(k, rf"(?<= ){p}(?= )", label, kind) for k, p, label, kind in spdx + bodies + notices + named]


def spelled(words: str) -> str:
    """Label of a name in normalised words: a dot within a version, else hyphens ("cc by 4 0" is cc-by-4.0)."""
    return re.sub(r"(?<= \d) (?=\d)", ".", words).replace(" ", "-")


def keywords() -> list[str]:
    return sorted({k for k, _, _, _ in rule_rows()})


def _prefilter() -> str:
    """A text can hold a base phrase or a rule only if this matches it; ASCII case is ignored, words stand alone."""
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    # Grouped by first letter, so that a word is tried against few keywords.
    groups = [f"{first}(?:{'|'.join(k[1:] for k in same)})" for first, same in groupby(keywords(), lambda k: k[0])]
    return rf"(?i)(?<!{letter})(?:{'|'.join(groups)})(?!{letter})"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, words joined by single blanks, one blank at either end."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _GAP, " ")), F.lit(" "))


def _places(words: Column, phrase: str) -> Column:
    """Starting words of all places where the phrase's words stand one after the other."""
    wanted = phrase.split(" ")
    last = F.size(words) - len(wanted)
    steps = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        same = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return same

    return F.filter(steps, stands)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every document.

    Null and empty texts have no words and no labels; null ids and repeated rows give a row each; an empty table gives none;
    other columns are not read.  ``score`` is the confidence of the surest detection left after suppression, 0 without one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # One pass over the texts; only those with a keyword take their normal form along.
    first = docs.select(
        F.col("doc_id").cast("long"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(_prefilter()), normalised(text)).alias("norm"),
    )
    first = materialize(first, "license-words")
    found = first.where("norm IS NOT NULL")
    words = F.split(F.trim("norm"), " ", -1)
    phrases = list(BASE)
    based = found.withColumn("words", words).select(
        "doc_id", "n_words", F.sha2("norm", 256).alias("digest"), *[_places(F.col("words"), p).alias(f"p{k}") for k, p in enumerate(phrases)]
    )
    places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(BASE[p])) for k, p in enumerate(phrases)]))
    based = based.select(
        "doc_id", "n_words", "digest", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
    )
    best = detections(spark, found.select("norm")).groupBy("digest").agg(
        F.collect_set("label").alias("own"), F.max("confidence").alias("confidence"), F.count("*").alias("n_detections")
    )
    scanned = based.join(best, "digest", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("confidence", F.when(F.size("base") > 0, F.lit(CONFIDENCE[NAME])), F.lit(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )
    none = F.lit(None).cast("long")
    rest = first.where("norm IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_detections"),
    )
    return scanned.unionByName(rest)


def detections(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Detections that stand after suppression, of distinct normalised texts: digest, label, priority, confidence, first and end word.

    A rule's places are counted in words: the text is split at its matches, and the sizes of the parts are summed in order.
    """
    # A few hundred rows, fixed by the code.
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(rule_rows())], "rule int, keyword string, pattern string, label string, priority int")
    texts = found.distinct().select("norm", F.sha2("norm", 256).alias("digest"))
    hit = F.filter(F.array(*map(F.lit, keywords())), lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k, F.lit(" "))))
    tried = texts.select("norm", "digest", F.explode(hit).alias("keyword")).join(F.broadcast(rules), "keyword").where(F.expr("rlike(norm, pattern)"))
    # The blanks at both ends of a match are left to the parts around it; a part's words are its blanks, less one at the end.
    blanks = "length(x) - length(replace(x, ' ', ''))"
    gaps = F.expr(f"transform(split(norm, pattern, -1), x -> {blanks})")
    sizes = F.expr(f"transform(regexp_extract_all(norm, pattern, 0), x -> {blanks} + 1)")
    parts = tried.select(
        "digest", "rule", "label", "priority", F.posexplode(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"))).alias("k", "part")
    )
    order = Window.partitionBy("digest", "rule").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        parts.select("*", F.col("part.gap").alias("gap"), F.col("part.size").alias("size"))
        # A part begins and ends with the blank next to a match; the text's first blank opens its first word.
        .withColumn("first", F.sum("gap").over(order) - 1 + F.coalesce(F.sum(F.coalesce(F.col("size"), F.lit(0)) - 1).over(before), F.lit(0)))
        .where("size IS NOT NULL").select("digest", "rule", "label", "priority", "first", (F.col("first") + F.col("size")).alias("end"))
    )
    # Covered: an earlier or longer detection of at least this priority reaches as far.
    around = Window.partitionBy("digest").orderBy("first", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(around) for p in (HINT, NAME, NOTICE, IDENTIFIER)]
    kept = spans.withColumn("reach", F.get(F.array(*reach), F.col("priority") - 1)).where("reach IS NULL OR reach < end")
    sure = F.get(F.array(*[F.lit(CONFIDENCE[p]) for p in (HINT, NAME, NOTICE, IDENTIFIER)]), F.col("priority") - 1)
    return kept.select("digest", "label", "priority", sure.alias("confidence"), "first", "end")
