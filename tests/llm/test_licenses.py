import re

from pyspark.sql import functions as F

from tests.helpers import plan_of
from tests.llm.helpers import ODD, documents
from tickerloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "MIT-License; mit license MIT/LICENSE", "permit license, CC-BY cc by CC by-nc-sa 4.0",
    "Licensed under the Apache License, Version 2.0 ... see LICENSE", "the apache\nlicense " * 300, "SPDX-License-Identifier: MIT", "cc by", "apache licenses mitlicense",
    "Copyright (c) 2019 Someone. All rights reserved.", "éapache license é", "gnu lesser general public license v2.1", "Kgnu general public license",
]


def scanned(spark):
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(TEXTS))]
    return rows, licenses.scan(documents(spark, rows)).collect()


def test_base_places_equal_brute_force(spark):
    rows, got = scanned(spark)
    want = sorted(((i, *base_of(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want


def test_labels_and_scores(spark):
    labels = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score, r.n_detections) for r in scanned(spark)[1]}
    assert labels[100][0] == {"gpl", "gpl-3.0"} and labels[100][1:] == (0.95, 1)
    assert labels[103][0] == {"apache", "apache-2.0"}
    assert labels[105] == ({"mit"}, 1.0, 1)
    assert labels[102][0] >= {"cc-by", "cc-by-nc-sa-4.0"}
    assert labels[104][2] == 300 and labels[104][0] == {"apache"}
    assert labels[107] == (set(), 0.0, 0) and labels[108][0] == {"all-rights-reserved", "copyright"}
    assert "lgpl-2.1" in labels[110][0] and "gpl" not in labels[110][0]
    for r in scanned(spark)[1]:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_spans_count_words(spark):
    text = "a gnu gpl b mit license c d released under the mit license"
    found = licenses.detections(spark, spark.createDataFrame([(f" {text} ",)], "norm string")).collect()
    assert sorted((r.label, r.first, r.end) for r in found) == [("gpl", 1, 3), ("mit", 4, 6), ("mit", 8, 13)]


BODIES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
    "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
    "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\"",
    "ncsa": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
    "deal with the Software without restriction",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED",
    "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-2-clause": "under a FreeBSD license",
    "apache-2.0": "you may not use this file except in compliance with the License.",
    "gpl-2.0": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "lgpl-2.1": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "agpl-3.0": "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "zlib": "The origin of this software must not be misrepresented;",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by",
    "json": "The Software shall be used for Good, not Evil.",
    "cc-by-4.0": "SPDX-License-Identifier: CC-BY-4.0",
    "bsd-2-clause ": "SPDX-License-Identifier: BSD-2-Clause",
}


def test_license_bodies_without_a_name(spark):
    # Labels of base phrases always stay; the mit-0 text also holds a warranty hint.
    got = licenses.scan(documents(spark, list(enumerate(BODIES.values())))).collect()
    found = {r.doc_id: (set(filter(None, r.labels.split(","))) - {*r.base_labels.split(","), "no-warranty"}, r.score) for r in got}
    sure = {"cc-by-4.0": 1.0, "bsd-2-clause ": 1.0, "bsd-2-clause": 0.8}
    for k, label in enumerate(BODIES):
        assert found[k] == ({label.strip()}, sure.get(label, 0.95)), label


def test_ordinary_prose_gets_no_label(spark):
    prose = ["We hereby thank every contributor for their compliance.", "Advertising may endorse a beer; the recipient keeps the document.", "Freedom to redistribute evil attribution verbatim."]
    assert {r.labels for r in licenses.scan(documents(spark, list(enumerate(prose)))).collect()} == {""}


def test_prefilter_passes_every_keyword_and_whole_words_only(spark):
    rows = [(w,) for k in licenses.keywords() for w in (k, k.upper(), f"({k})")] + [(f"x{k}",) for k in licenses.keywords()] + [(f"{k}é",) for k in licenses.keywords()]
    frame = spark.createDataFrame(rows, "w string").withColumn("hit", F.col("w").rlike(licenses._prefilter()))
    alone = set(licenses.keywords())
    for r in frame.collect():
        assert r.hit == (r.w.strip("()").lower() in alone), r.w


def test_rules():
    rows = licenses.rule_rows()
    assert len(rows) > 300
    for label in {r[2] for r in rows}:
        assert re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+(\.\d+)*)*", label), label
    for keyword, pattern, _, _ in rows:
        re.compile(pattern)


def test_empty_table_and_plan(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
    plan = plan_of(licenses.scan(documents(spark, ODD)))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
