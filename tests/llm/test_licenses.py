import re

from trovelight.llm import licenses

ROWS = [
    (1, "Released under the MIT License."),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "mit license MIT LICENSE, mit-license"),
    (4, None),
    (5, ""),
    (6, "Er kam mit der Lizenz. permit license"),
    (7, "The Apache License, Version 2.0 and then the BSD 3-Clause license. All rights reserved."),
    (8, "SPDX-License-Identifier: Apache-2.0"),
    (8, "SPDX-License-Identifier: Apache-2.0"),
    (9, "ümit license"),
    (10, "a licence for dogs"),
    (None, "general\npublic\tlicense " * 300),
]


def base(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in found)
    return len(words), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def scanned(spark, rows):
    return licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string"))


def test_base_matches_plain_counting(spark):
    found = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scanned(spark, ROWS).collect()}
    assert found == {(i, *base(t)) for i, t in ROWS}


def test_labels(spark):
    found = {r.doc_id: (r.labels, r.score) for r in scanned(spark, ROWS).collect()}
    assert found[1] == ("mit", 1.0)
    assert found[2] == ("gpl,gpl-3.0", 1.0)
    assert found[7][0] == "apache,apache-2.0,bsd-3-clause,proprietary"
    assert found[8] == ("apache-2.0", 1.0)
    assert found[4] == found[5] == found[6] == found[9] == found[10] == ("", 0.0)
    assert scanned(spark, ROWS).count() == len(ROWS)
    assert scanned(spark, [ROWS[0]]).limit(0).count() == 0


def test_containment(spark):
    """A general rule inside a more telling one is gone; one beside it stays."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(0, "x licensed under the mit license y".split()), (1, "mit license a b apache license".split())], "row int, words array<string>")
    found = licenses.detections(texts).select("row", "label", "start", "stop").orderBy("row", "start").collect()
    assert [tuple(r) for r in found] == [(0, "mit", 1, 6), (1, "mit", 0, 2), (1, "apache", 4, 6)]
    assert licenses.detections(texts.filter(F.lit(False))).count() == 0


def test_rules_are_hundreds_and_compile():
    assert len(licenses.rules()) > 250
    assert all(re.compile(r[3]) for r in licenses.rules())


def written(pattern):
    """Texts that a pattern matches: for each of its choices one with each alternative, the other choices at their first."""
    from re import _parser

    def options(op, arg):
        match str(op):
            case "LITERAL":
                return [chr(arg)]
            case "IN":
                return [chr(a) if str(o) == "LITERAL" else chr(a[1]) for o, a in arg]
            case "BRANCH":
                return [t for branch in arg[1] for t in every(branch)]
            case "SUBPATTERN":
                return every(arg[-1])
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, _, inner = arg
                return ([""] if low == 0 else []) + every(inner)
            case "ASSERT":
                return [""]
        raise ValueError(op)

    def every(parsed):
        choices = [options(*part) for part in parsed]
        first = [c[-1] for c in choices]
        return list(dict.fromkeys("".join([*first[:i], x, *first[i + 1 :]]) for i, c in enumerate(choices) for x in c))

    return every(_parser.parse(pattern))


def ungated(text):
    """Labels and score by every rule on every text, without keywords and cues."""
    spans = []
    for rule, label, _, pattern, priority, score, *_ in licenses.rules():
        for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", text):
            spans.append((m.start(), -m.end(), -priority, rule, label, score))
    spans.sort()
    kept = [s for i, s in enumerate(spans) if not any(o[1] <= s[1] and o[2] <= s[2] for o in spans[:i])]
    base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {text} "}
    return ",".join(sorted({s[4] for s in kept} | base)), max([s[5] for s in kept] + [0.8 if base else 0.0])


def test_keywords_and_cues_lose_no_match(spark):
    """Every alternative of every rule, written out, is found as it is without the gate."""
    texts = {}
    names = {}
    for x in licenses.LICENSES:
        names.setdefault(x[0], []).extend(written(x[2]))
    for form, *_ in [*licenses.FORMS, licenses.VERSIONED]:
        around = written(form.replace("NAME", "zzz"))
        for name, forms in names.items():
            for text in [a.replace("zzz", forms[0]) for a in around] + [around[0].replace("zzz", n) for n in forms]:
                texts[text] = name
    for label, _, pattern in licenses.SHORT:
        for form, *_ in licenses.TAGS:
            texts |= {form.split("NAME")[0].replace("[cs]", "s") + t: label for t in written(pattern)}
    for label, _, pattern, *_ in licenses.PLAIN:
        texts |= {t: label for t in written(pattern)}
    patterns = {}
    for r in licenses.rules():
        patterns.setdefault(r[1], []).append(re.compile(f"(?<![^ ])(?:{r[3]})(?![^ ])"))
    texts = sorted(t for t, label in texts.items() if any(p.search(t) for p in patterns[label]))
    assert len(texts) > 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).select("doc_id", "labels", "score").collect()}
    assert {t: found[i] for i, t in enumerate(texts)} == {t: ungated(t) for t in texts}


def test_names_without_the_word_license(spark):
    rows = [
        ("Released under CC0 1.0", "cc0-1.0"),
        ("distributed under the terms of zlib", "zlib"),
        ("covered by the Artistic 2.0", "artistic-2.0"),
        ("SPDX-License-Identifier: 0BSD", "0bsd"),
        ("0BSD license", "0bsd"),
        ("the GNU Library General Public License 2.0", "gpl,lgpl-2.0"),
    ]
    found = scanned(spark, [(i, t) for i, (t, _) in enumerate(rows)]).select("doc_id", "labels").collect()
    assert {r.doc_id: r.labels for r in found} == {i: label for i, (_, label) in enumerate(rows)}


#: Sentences and the labels that a reader gives them.
LABELLED = (
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by-4.0"),
    ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", "cc-by-nc-nd-4.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0"),
    ("SPDX-License-Identifier: EPL-2.0 AND MIT", "epl-2.0,mit"),
    ("SPDX-License-Identifier: BSL-1.0", "boost-1.0"),
    ("SPDX-License-Identifier: OFL-1.1", "ofl-1.1"),
    ("licensed under the GPLv3", "gpl-3.0"),
    ("This program is licensed under the GPLv2+.", "gpl-2.0"),
    ("released under GPL v2", "gpl-2.0"),
    ("Released under the GNU GPL version 3 or later", "gpl-3.0"),
    ("available under the LGPL 2.1", "lgpl-2.1"),
    ("LGPLv2.1+ applies to the library", "lgpl-2.1"),
    ("our server is AGPLv3", "agpl-3.0"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Photos: CC BY 3.0", "cc-by-3.0"),
    ("texts are under CC BY-NC-SA 4.0 unless noted", "cc-by-nc-sa-4.0"),
    ("dual licensed under MIT or Apache 2.0", "apache-2.0,mit"),
    ("Dual-licensed under the MIT license and the GPLv2", "gpl-2.0,mit"),
    ("documentation under the GFDL 1.3", "gfdl"),
    ("maps under ODbL 1.0", "odbl-1.0"),
    ("code: CDDL 1.0, docs: EUPL 1.2", "cddl-1.0,eupl-1.2"),
    ("MPL 1.1 and MPL 2.0 differ", "mpl-1.1,mpl-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("cc by the editor, 4 of 10", ""),
    ("the gpl crowd met for lunch", ""),
    ("she drove 2 miles or 3 and a python slept", ""),
    ("He was licensed under state law to practise medicine and ruby mining", ""),
    ("Apache 2.0 served the page", ""),
    ("mit or without, the bsd daemon smiles", ""),
)


def test_hand_labelled_sentences(spark):
    found = {r.doc_id: r.labels for r in scanned(spark, [(i, t) for i, (t, _) in enumerate(LABELLED)]).collect()}
    assert {LABELLED[i][0]: x for i, x in found.items()} == dict(LABELLED)


def test_long_and_repeated_texts(spark):
    long = "word " * 200_000 + "licensed under the GPLv3 " + "word or " * 200_000
    rows = [(1, long), (1, long), (2, "gpl v2 " * 20_000)]
    found = scanned(spark, rows).select("doc_id", "n_words", "labels").collect()
    assert sorted(map(tuple, found)) == [(1, 600_004, "gpl-3.0"), (1, 600_004, "gpl-3.0"), (2, 40_000, "gpl-2.0")]
