"""License scans: ordered signature rules with a keyword gate, priorities and containment.

Rules are regular expressions over the lower-cased words of a text (letters and
digits, parted by blanks). They come from a table of licenses, each with its
names, crossed with the phrases in which licenses are named, from a table of short
names that tell a license by themselves, and from openings of license texts; a rule has a keyword,
a label, a priority, a score and a cue. A text meets only the rules whose keyword it
holds as a word and whose cue it holds. Both are words that every match of the rule
holds, so they keep no match from being found; names without a word in common are
rules of their own. A detection goes if another of equal or higher priority contains it; of equal intervals the
higher priority stays, then the earlier rule.

All of it is DataFrame functions. The rule table is fixed, and small whatever the
corpus; texts without any keyword pass by with three cheap expressions.

Defined cases: a null text is empty: no words, no labels, score 0. Repeated rows come
back as often as they stand; empty input gives empty output; texts of any length
are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm.common import NOT_ALNUM, ascii_lower, col, let, pieces

#: Fixed by the contract: phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, a word that all forms of the name hold, and these forms as patterns over blank-parted words.
LICENSES = (
    ("mit", "mit", r"(?:the )?mit(?: x11)?(?: expat)?"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("expat", "expat", r"(?:the )?expat"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license)? (?:v|version )?1 1"),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)?(?: license)? (?:v|version )?2(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original|old|4 clause|four clause) bsd|bsd 4 clause"),
    ("0bsd", "bsd", r"(?:the )?(?:zero clause bsd|bsd zero clause)"),
    ("0bsd", "0bsd", r"(?:the )?0bsd"),
    ("isc", "isc", r"(?:the )?isc"),
    ("gpl-1.0", "public", r"(?:the )?(?:gnu )?general public(?: license)? (?:v|version )?1(?: 0)?"),
    ("gpl-2.0", "public", r"(?:the )?(?:gnu )?general public(?: license)? (?:v|version )?2(?: 0)?"),
    ("gpl-3.0", "public", r"(?:the )?(?:gnu )?general public(?: license)? (?:v|version )?3(?: 0)?"),
    ("lgpl-2.0", "lesser", r"(?:the )?(?:gnu )?lesser general public(?: license)? (?:v|version )?2(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:the )?(?:gnu )?library general public(?: license)? (?:v|version )?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:the )?(?:gnu )?lesser general public(?: license)? (?:v|version )?2 1"),
    ("lgpl-3.0", "lesser", r"(?:the )?(?:gnu )?lesser general public(?: license)? (?:v|version )?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public(?: license)? (?:v|version )?3(?: 0)?"),
    ("gfdl", "documentation", r"(?:the )?(?:gnu )?free documentation"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public(?: license)? (?:v|version )?1 1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public(?: license)? (?:v|version )?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public(?: license)? (?:v|version )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public(?: license)? (?:v|version )?2(?: 0)?"),
    ("edl-1.0", "eclipse", r"(?:the )?eclipse distribution"),
    ("cddl-1.0", "distribution", r"(?:the )?common development and distribution(?: license)? (?:v|version )?1(?: 0)?"),
    ("cpl-1.0", "common", r"(?:the )?common public(?: license)? (?:v|version )?1(?: 0)?"),
    ("eupl-1.2", "union", r"(?:the )?european union public(?: licen[cs]e)? (?:v|version )?1 2"),
    ("cc0-1.0", "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by-3.0", "attribution", r"(?:the )?creative commons attribution(?: license)? (?:v|version )?3 0"),
    ("cc-by-4.0", "attribution", r"(?:the )?creative commons attribution(?: international)?(?: license)? (?:v|version )?4 0"),
    ("cc-by-sa-3.0", "attribution", r"(?:the )?creative commons attribution share ?alike(?: license)? (?:v|version )?3 0"),
    ("cc-by-sa-4.0", "attribution", r"(?:the )?creative commons attribution share ?alike(?: license)? (?:v|version )?4 0"),
    ("cc-by-nc-4.0", "noncommercial", r"(?:the )?creative commons attribution noncommercial(?: license)? (?:v|version )?4 0"),
    ("cc-by-nd-4.0", "noderivatives", r"(?:the )?creative commons attribution noderivatives(?: license)? (?:v|version )?4 0"),
    ("cc-by-nc-sa-4.0", "noncommercial", r"(?:the )?creative commons attribution noncommercial share ?alike(?: license)? (?:v|version )?4 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("libpng", "libpng", r"(?:the )?libpng"),
    ("boost-1.0", "boost", r"(?:the )?boost software(?: license)? (?:v|version )?1(?: 0)?"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic(?: license)? (?:v|version )?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic(?: license)? (?:v|version )?2(?: 0)?"),
    ("python-2.0", "python", r"(?:the )?python(?: software foundation)?(?: license)? (?:v|version )?2(?: 0)?"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("php-3.0", "php", r"(?:the )?php(?: license)? (?:v|version )?3(?: 0)?"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal"),
    ("ofl-1.1", "font", r"(?:the )?(?:sil )?open font(?: license)? (?:v|version )?1 1"),
    ("odbl-1.0", "database", r"(?:the )?open (?:data commons )?database(?: license)? (?:v|version )?1(?: 0)?"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?"),
    ("afl-3.0", "academic", r"(?:the )?academic free(?: license)? (?:v|version )?3(?: 0)?"),
    ("osl-3.0", "open", r"(?:the )?open software(?: license)? (?:v|version )?3(?: 0)?"),
    ("vim", "vim", r"(?:the )?vim"),
    ("ijg", "jpeg", r"(?:the )?independent jpeg group"),
    ("curl", "curl", r"(?:the )?curl"),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat"),
)
#: Short names of SPDX and of common use that tell a license wherever they stand: label, keyword, pattern.
SHORT = (
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl (?:v|version )?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:v|version )?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl2", r"(?:gnu )?gpl2"),
    ("gpl-3.0", "gpl3", r"(?:gnu )?gpl3"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl (?:v|version )?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:v|version )?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "lgplv2", r"(?:gnu )?lgplv2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl (?:v|version )?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: 0)?(?: only| or later)?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: 1 [123])?(?: only| or later)?"),
    ("mpl-1.1", "mpl", r"mpl (?:v|version )?1 1"),
    ("mpl-2.0", "mpl", r"mpl (?:v|version )?2(?: 0)?"),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?"),
    ("epl-1.0", "epl", r"epl (?:v|version )?1(?: 0)?"),
    ("epl-2.0", "epl", r"epl (?:v|version )?2(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl (?:v|version )?1(?: 0)?"),
    ("eupl-1.2", "eupl", r"eupl (?:v|version )?1 2"),
    ("cc0-1.0", "cc0", r"cc0 1 0(?: universal)?"),
    ("cc-by-3.0", "cc", r"cc by 3 0"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0"),
    ("boost-1.0", "bsl", r"bsl 1 0"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl (?:v|version )?1 1"),
    ("odbl-1.0", "odbl", r"odbl (?:v|version )?1(?: 0)?"),
    ("afl-3.0", "afl", r"afl 3 0"),
    ("osl-3.0", "osl", r"osl 3 0"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause"),
)
#: Cues: a form of naming cannot match a text that lacks its own.
ANY, UNDER, BY, SPEAKS = "", " under ", "(?:subject to|accordance with|governed by|covered by|compliance with) ", "licen[cs]e"
LISTS = "(?:licen[cs]ed under|licen[cs]e identifier) "
CUES = (ANY, UNDER, BY, SPEAKS, LISTS)
#: How licenses are named: pattern around the name, priority, score, cue. Earlier rules win ties.
FORMS = (
    (r"(?:is |are )?(?:licen[cs]ed|released|distributed|available|provided|published)(?: for use)? under(?: the terms of)? NAME(?: licen[cs]e)?(?: (?:v|version )?[0-9]+(?: [0-9]+)?)?", 3, 1.0, UNDER),
    (r"(?:subject to|in accordance with|governed by|covered by|compliance with)(?: the terms of)? NAME(?: licen[cs]e)?", 3, 0.95, BY),
    (r"spdx licen[cs]e identifier NAME", 4, 1.0, SPEAKS),
    (r"NAME licen[cs]e(?: (?:v|version )?[0-9]+(?: [0-9]+)?)?", 2, 0.9, SPEAKS),
    (r"licen[cs]e NAME", 1, 0.7, SPEAKS),
)
#: A name with its version and the word in between or behind.
VERSIONED = (r"(?=(?:[^ ]+ ){1,4}licen[cs]e )NAME", 2, 0.85, SPEAKS)
#: Short names: alone, and as a file's tag.
TAGS = ((r"NAME(?: licen[cs]e)?", 2, 0.85, ANY), (r"spdx licen[cs]e identifier NAME", 4, 1.0, LISTS))
#: Words that stand between the licenses of a choice, or in their names.
BETWEEN = r"(?:the|either|both|terms|of|or|and|only|later|licen[cs]e|version|v?[0-9]+|gnu|general|public|lesser|affero|software|clause|new|revised|simplified|mit|x11|expat|isc|zlib|unlicense|boost|mozilla|eclipse|apache|bsd|cc0?|by|sa|(?:l|a)?gpl(?:v?[0-9])?|mpl|epl)"
#: A further license of a choice; of low priority, so it suppresses none of those before it.
CHOICE = (rf"(?:licen[cs]ed under|licen[cs]e identifier) (?:{BETWEEN} ){{1,12}}?(?:or|and) NAME(?: licen[cs]e)?", 1, 0.9, LISTS)
#: Rules without a license's name, by label, keyword, pattern, priority and score.
PLAIN = (
    ("gpl", "public", r"(?:gnu )?general public licen[cs]e", 1, 0.8),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", 1, 0.8),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 1, 0.8),
    ("creative-commons", "creative", r"creative commons(?: attribution)?", 1, 0.6),
    ("proprietary", "reserved", r"all rights reserved", 1, 0.4),
    ("public-domain", "domain", r"(?:released into|dedicated to|placed in) the public domain", 2, 0.9),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu", 3, 1.0),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.7),
)


def rules() -> list[tuple[int, str, str, str, int, float, str]]:
    """All rules, in order: number, label, keyword, pattern, priority, score, cue."""
    forms = [(form, x) for form in FORMS for x in LICENSES] + [(VERSIONED, x) for x in LICENSES if "." in x[0]]
    forms += [(form, x) for form in TAGS for x in SHORT] + [(CHOICE, x) for x in LICENSES]
    made = [(label, word, form.replace("NAME", f"(?:{name})"), priority, score, cue) for (form, priority, score, cue), (label, word, name) in forms]
    return [(i, *r) for i, r in enumerate([*((*r, ANY) for r in PLAIN), *made])]


def gate() -> str:
    """What a text must hold before it is cut into words: the keyword of some rule, in any case, as a word."""
    edge = NOT_ALNUM.replace(r"\x60", r"\x40\x5B-\x60")
    by: dict[str, list[str]] = {}
    for keyword in sorted({r[2] for r in rules()}):
        by.setdefault(keyword[0], []).append(keyword[1:])
    return f"(?i)(?:^|{edge})(?:{'|'.join(f'{k}(?:{"|".join(v)})' for k, v in by.items())})(?:$|{edge})"


def wrapped(words: Column) -> Column:
    """Words with a blank on both sides of each, so that neighbours share none."""
    return F.when(F.size(words) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))


def _phrase(text: str) -> str:
    return "".join(f" {w} " for w in text.split())


def _base(held: Column) -> Column:
    """Places of the fixed phrases in wrapped words: n, first, last, labels."""

    def one(phrase: str, label: str) -> Column:
        form = _phrase(phrase)
        n = (F.length(held) - F.length(F.replace(held, F.lit(form), F.lit("")))) / len(form)
        before, after = F.substring_index(held, form, 1), F.substring_index(held, form, -1)
        total, width = _count(held), len(phrase.split())
        found = n > 0
        return F.struct(
            n.cast("long").alias("n"),
            F.when(found, _count(before)).alias("first"),
            F.when(found, total - _count(after) - width).alias("last"),
            F.when(found, F.lit(label)).alias("label"),
        )

    every = [one(*p) for p in PHRASES]
    return F.struct(
        sum((e["n"] for e in every), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(e["first"] for e in every)).alias("first_word"),
        F.greatest(*(e["last"] for e in every)).alias("last_word"),
        F.array_compact(F.array(*(e["label"] for e in every))).alias("labels"),
    )


def _count(held: Column) -> Column:
    """Words in wrapped words: half the blanks."""
    return ((F.length(held) - F.length(F.replace(held, F.lit(" "), F.lit("")))) / 2).cast("long")


def rule_map() -> Column:
    """The rules by keyword, as a constant map of arrays."""
    by: dict[str, list[Column]] = {}
    for rule, label, keyword, pattern, priority, score, cue in rules():
        fields = {"rule": rule, "label": label, "pattern": pattern, "priority": priority, "score": score, "cue": CUES.index(cue) + 1}
        by.setdefault(keyword, []).append(F.struct(*(F.lit(v).alias(k) for k, v in fields.items())))
    return F.create_map(*(x for k, v in by.items() for x in (F.lit(k), F.array(*v))))


def detections(texts: DataFrame) -> DataFrame:
    """row, label, rule, priority, score, start, stop (word numbers): of `texts` (row, words), what no other detection suppresses."""
    single = F.array_join("words", " ")
    held = F.array_intersect(F.col("words"), F.array(*(F.lit(k) for k in sorted({r[2] for r in rules()}))))
    cues = F.array(*(F.col("text").rlike(c) for c in CUES))
    keyed = texts.select("row", single.alias("text"), held.alias("held")).filter(F.size("held") > 0).select("row", "text", cues.alias("cues"), F.explode("held").alias("keyword"))
    told = F.filter(F.element_at(rule_map(), F.col("keyword")), lambda r: F.element_at(F.col("cues"), r["cue"]))
    gated = keyed.select("row", "text", F.explode(told).alias("r")).select("row", "text", "r.*").drop("cue")
    bounded = F.concat(F.lit("(?<![^ ])(?:"), F.col("pattern"), F.lit(")(?![^ ])"))
    matched = gated.withColumn("form", bounded).filter(F.rlike(F.col("text"), F.col("form")))
    # Text between matches and the matches themselves, in turn, give every match's place.
    parts = matched.select(
        "row", "label", "rule", "priority", "score", F.posexplode(F.arrays_zip(F.split("text", F.col("form"), -1).alias("gap"), F.regexp_extract_all("text", F.col("form"), F.lit(0)).alias("hit"))).alias("k", "part")
    )
    blanks = lambda x: F.length(F.coalesce(x, F.lit(""))) - F.length(F.translate(F.coalesce(x, F.lit("")), " ", ""))
    sums = parts.withColumns({"gap": blanks(F.col("part.gap")), "hit": blanks(F.col("part.hit")), "has": F.col("part.hit").isNotNull()}).drop("part")
    # Copies of a row are told here, by numbers alone, and not by their texts before.
    sums = sums.dropDuplicates(["row", "rule", "k"])
    order = Window.partitionBy("row", "rule").orderBy("k")
    before = F.coalesce(F.sum(F.col("gap") + F.col("hit")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("gap")
    placed = sums.withColumns({"start": before, "stop": before + F.col("hit") + 1}).filter("has").drop("has", "gap", "hit", "k")
    # In order of start, longest first, a detection lies inside an earlier one if any of these reaches as far; it yields to those of its priority or above.
    earlier = Window.partitionBy("row").orderBy("start", F.col("stop").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for p in sorted({r[4] for r in rules()}):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(earlier)).otherwise(reach)
    return placed.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).drop("reach")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    raw = F.coalesce(col(docs, text), F.lit(""))
    slim = docs.select(col(docs, doc_id).alias("doc_id"), raw.alias("text"))
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    # The gate reads the raw text once; only what passes is cut into words.
    passes = F.col("text").rlike(gate())
    words = F.when(passes, pieces(ascii_lower(F.col("text")), NOT_ALNUM)).otherwise(F.array().cast("array<string>"))
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    based = slim.select("doc_id", row.alias("row"), n_words.alias("n_words"), let(words, lambda w: let(wrapped(w), _base)).alias("b"))
    gated = slim.filter(passes).select(row.alias("row"), pieces(ascii_lower(F.col("text")), NOT_ALNUM).alias("words"))
    per_row = detections(gated).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    joined = based.join(per_row, "row", "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.col("b.n_base").alias("n_base"),
        F.col("b.first_word").alias("first_word"),
        F.col("b.last_word").alias("last_word"),
        listed(F.col("b.labels")).alias("base_labels"),
        listed(F.concat(F.col("b.labels"), F.coalesce("found", none))).alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("b.n_base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )
