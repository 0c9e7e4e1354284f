"""License scans: ordered signature rules over normalised words, with DataFrame functions only.

A text becomes a string in which every word stands between two blanks of its own (' gnu  general  public  license '),
so that a phrase is found by a plain search and neighbouring finds never share a blank. Rules are regular expressions
over that form, in order of priority, each behind a keyword. Three gates keep the work small: texts without any root
keyword see no rule at all; a rule sees only texts with its keyword; only then does its expression run.

Overlapping detections: a detection is suppressed when an earlier-ordered one (lower priority number, or the
same and longer, or the same and listed first) covers its whole interval of words. Detections are swept by start with the
furthest end seen so far for each priority. A fold that adds to an array copies it, so folds go over blocks of BLOCK
elements: a text's work grows with its detections.

The four base phrases are located apart from the rules and are never suppressed.

Defined results: null and empty texts have 0 words and places, null first and last words, empty labels, score 0;
doc_id may be null or repeat (nothing is grouped by it); other columns of the table are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, and the base phrases with their labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.9

# Label, keywords, name as a regular expression over words, SPDX identifiers as words.
FAMILIES = [
    ("gpl-1.0", "gnu|gpl*", r"gnu (?:general public license|gpl) (?:version |v)?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu|gpl*", r"(?:gnu general public license |gnu gpl ?|gpl ?)(?:version |v )?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu|gpl*", r"(?:gnu general public license |gnu gpl ?|gpl ?)(?:version |v )?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "library general|lgpl*", r"(?:gnu )?(?:library general public license|lgpl) (?:version |v )?v?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general|lgpl*", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?v?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general|lgpl*", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero|agpl", r"(?:gnu )?affero general public license(?: version 3)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", "documentation license|gfdl", r"(?:gnu )?free documentation license", r"gfdl 1 [123](?: only| or later)?"),
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version )?1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version )?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v)?2(?: 0)?", r"apache 2 0"),
    ("mit", "mit", r"mit (?:style |x11 )?licen[sc]e", r"mit"),
    ("mit-0", "mit", r"mit no attribution licen[sc]e", r"mit 0"),
    ("x11", "x11", r"x11 licen[sc]e", r"x11"),
    ("isc", "isc", r"isc licen[sc]e", r"isc"),
    ("bsd-1-clause", "bsd", r"(?:bsd )?1 clause bsd licen[sc]e", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[sc]e", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) licen[sc]e", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", r"bsd"),
    ("0bsd", "0bsd|zero clause", r"(?:zero clause bsd|0bsd) licen[sc]e", r"0bsd"),
    ("mpl-1.0", "mozilla|mpl", r"(?:mozilla public license|mpl) (?:version )?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla|mpl", r"(?:mozilla public license|mpl) (?:version )?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl", r"(?:mozilla public license|mpl) (?:version |v )?2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse|epl", r"(?:eclipse public license|epl) (?:version |v )?v?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse|epl", r"(?:eclipse public license|epl) (?:version |v )?v?2(?: 0)?", r"epl 2 0"),
    ("edl-1.0", "eclipse|edl", r"eclipse distribution license", r"edl 1 0"),
    ("cddl-1.0", "common development|cddl", r"(?:common development and distribution license|cddl)(?: version)?(?: 1 0)?", r"cddl 1 [01]"),
    ("cpl-1.0", "common public|cpl", r"common public license(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("ipl-1.0", "ibm|ipl", r"ibm public license", r"ipl 1 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: 1 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version )?2(?: 0)?", r"artistic 2 0"),
    ("perl", "as perl|artistic 1 0 perl", r"same terms as perl(?: itself)?", r"artistic 1 0 perl"),
    ("python-2.0", "python|psf", r"(?:python software foundation|psf|python) license", r"(?:psf|python) 2 0"),
    ("php-3.01", "php", r"php license", r"php 3 01?"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng", r"libpng license", r"libpng(?: 2 0)?"),
    ("bsl-1.0", "boost|bsl", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("busl-1.1", "business source|busl", r"business source license(?: 1 1)?", r"busl 1 1"),
    ("sspl-1.0", "server side|sspl", r"server side public license", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2 0)?", r"elastic 2 0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "you want to|wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", r"wtfpl"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("ofl-1.1", "font license|ofl", r"(?:sil )?open font license", r"ofl 1 [01]"),
    ("osl-3.0", "open software|osl", r"open software license", r"osl 3 0"),
    ("afl-3.0", "academic free|afl", r"academic free license", r"afl 3 0"),
    ("eupl-1.2", "european union|eupl", r"(?:european union public licen[sc]e|eupl)", r"eupl 1 [012]"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)? license", r"cecill(?: [bc12])?(?: [01])?"),
    ("ms-pl", "microsoft|ms pl", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft|ms rl", r"microsoft reciprocal license", r"ms rl"),
    ("odbl-1.0", "database license|odbl", r"open (?:data commons open )?database license", r"odbl 1 0"),
    ("pddl-1.0", "dedication and|pddl", r"public domain dedication and license", r"pddl 1 0"),
    ("cc0-1.0", "creative commons|cc0|cc 0", r"(?:creative commons zero|cc0|cc 0)(?: license)?(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "creative commons|cc by", r"(?:creative commons attribution|cc by)(?: license)?(?: [1234] 0)?(?: international)?", r"cc by [1234] 0"),
    ("cc-by-sa", "creative commons|cc by", r"(?:creative commons attribution share ?alike|cc by sa)(?: license)?(?: [1234] 0)?(?: international)?", r"cc by sa [1234] 0"),
    ("cc-by-nc", "creative commons|cc by", r"(?:creative commons attribution non ?commercial|cc by nc)(?: license)?(?: [1234] 0)?(?: international)?", r"cc by nc [1234] 0"),
    ("cc-by-nd", "creative commons|cc by", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: license)?(?: [1234] 0)?", r"cc by nd [1234] 0"),
    ("cc-by-nc-sa", "creative commons|cc by", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: license)?(?: [1234] 0)?", r"cc by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creative commons|cc by", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: license)?(?: [1234] 0)?", r"cc by nc nd [1234] 0"),
    ("gpl", "gnu|gpl*", r"gnu (?:general public licen[sc]e|gpl)", r"gpl"),
    ("lgpl", "gnu|lgpl", r"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl)", r"lgpl"),
    ("apache", "apache", r"apache licen[sc]e", r"apache"),
]

# How a license is named: (priority, confidence, expression around a family's name or identifier).
NOTICES = [
    (0, 1.0, "id", r"spdx license identifier {}"),
    (1, 0.95, "name", r"licen[sc]ed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}"),
    (1, 0.92, "name", r"(?:released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}"),
    (3, 0.8, "name", r"(?:see|subject to|governed by|covered by|use of|copy of) (?:the )?{}"),
    (4, 0.7, "name", r"{}"),
]

# Sentences of license texts: label, keywords, confidence, expression.
SENTENCES = [
    ("mit", "permission is hereby", 0.98, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense and or", 0.8, r"to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission to use", 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", 0.9, r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "to endorse", 0.9, r"neither the name of .{1,60}? nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "advertising materials", 0.9, r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "apache org", 0.98, r"apache org licenses license 2 0"),
    ("apache-2.0", "compliance with the license", 0.9, r"you may not use this file except in compliance with the license"),
    ("apache", "apache software foundation", 0.85, r"licensed to the apache software foundation"),
    ("gpl", "is free software", 0.95, r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "fitness for", 0.6, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "is free software", 0.95, r"this library is free software you can redistribute it and or modify it"),
    ("gpl", "gnu", 0.9, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "gnu", 0.9, r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "affero|agpl", 0.9, r"you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", "eclipse", 0.9, r"the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "altered source", 0.85, r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost org", 0.9, r"boost org license 1 0 txt"),
    ("unlicense", "unencumbered", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you want to", 0.9, r"you just do what the fuck you want to"),
    ("public-domain", "public domain", 0.7, r"(?:placed|dedicated|released|is) (?:in|into|to) the public domain"),
    ("cc", "creativecommons", 0.9, r"creativecommons org licenses [a-z]+"),
    ("cc0-1.0", "creativecommons", 0.9, r"creativecommons org publicdomain zero 1 0"),
    ("ofl-1.1", "reserved font", 0.85, r"with reserved font name"),
    ("proprietary", "rights reserved", 0.5, r"all rights reserved"),
    ("proprietary", "and confidential", 0.6, r"proprietary and confidential"),
    ("proprietary", "strictly prohibited", 0.6, r"unauthorized (?:copying|use|reproduction) .{0,60}?is strictly prohibited"),
    ("as-is", "as is without", 0.4, r"provided as is without (?:any )?warranty"),
    ("generic", "licensed under", 0.3, r"licensed under the terms"),
    ("generic", "license for|license file", 0.3, r"see (?:the )?license (?:file )?for (?:more )?(?:details|information)"),
]

# A text without any of these holds no rule's match: every name and sentence either has "licen" in it or one of these.
ROOTS = [
    "licen", " gpl", " lgpl", " gnu  gpl ", " mpl ", " epl ", " cddl", " common  development ", " you  want  to ", " wtfpl ", " eupl ", " as  perl ", " cc0 ", " cc  0 ", " cc  by ", " creative  commons ",
    " permission  is  hereby ", " permission  to  use ", " redistribution  and  use ", " to  endorse ", " advertising  materials ", " apache  software  foundation ", " is  free  software ", " fitness  for ", " altered  source ",
    " boost  org ", " unencumbered ", " public  domain ", " creativecommons ", " reserved  font ", " rights  reserved ", " and  confidential ", " strictly  prohibited ", " as  is  without ", " apache  org ",
]


def spaced(expression: str) -> str:
    """A rule written with single blanks, over the form with two: each word keeps a blank on either side."""
    return f" {expression.replace(' ?', chr(0)).replace(' ', '  ').replace(chr(0), '(?:  )?')} "


def rules() -> list[dict]:
    """All signature rules, in order. The rule number orders rules of one priority; more specific names come first."""
    out = []
    keywords = lambda key: [f" {k[:-1]}" if k[-1] == "*" else spaced(k) for k in key.split("|")]  # noqa: E731  gpl* is found in gplv2
    for label, key, name, ident in FAMILIES:
        for priority, confidence, of, form in NOTICES:
            if priority == 4 and label in BASE.values() and label != "cc-by":
                confidence = BASE_CONFIDENCE
            out.append({"label": label, "keys": keywords(key), "priority": priority, "confidence": confidence, "re": spaced(form.format(f"(?:{name if of == 'name' else ident})"))})
    for label, key, confidence, sentence in SENTENCES:
        out.append({"label": label, "keys": keywords(key), "priority": 2, "confidence": confidence, "re": spaced(sentence)})
    for n, r in enumerate(out):
        r["rule"] = n
    return out


PRIORITIES = 5
#: Elements that are folded into one array.
BLOCK = 128
RULE_TYPE = "array<struct<rule:int,label:string,keys:array<string>,priority:int,confidence:double,re:string>>"
DETECTION = "struct<start:bigint,end:bigint,priority:int,rule:int,label:string,confidence:double>"


def normalised(text: Column) -> Column:
    """Lower-cased words, each between two blanks of its own; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = F.trim(F.regexp_replace(plain, GAP, "  "))
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def n_words(norm: Column) -> Column:
    """Words of a string in the normal form: two blanks each."""
    return ((F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))) / 2).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), the value worked out once: as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, zero, step) -> Column:
    """The out arrays of a fold over items, put together. zero: what a block's fold begins with (its out is empty), from the state of
    the block before it, which has the same fields; step adds to the out of its own block only."""
    add = lambda acc, block: F.concat(acc, F.array(F.aggregate(block, zero(F.element_at(acc, -1)), step)))

    def over(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.transform(F.aggregate(blocks, F.array(zero(None)), add), lambda x: x["out"]))

    return _let(items, lambda items: F.when(F.size(items) > 0, over(items)).otherwise(F.from_json(F.lit("[]"), F.lit(f"array<{DETECTION}>"))))


def detections(norm: Column, rule_list: list[dict] | None = None) -> Column:
    """All detections of the rules, sorted for the sweep. Positions count words from 0; end is past the last word."""
    table = F.from_json(F.lit(json.dumps(rules() if rule_list is None else rule_list)), F.lit(RULE_TYPE))
    nothing = F.from_json(F.lit("[]"), F.lit(f"array<{DETECTION}>"))

    def of(r: Column) -> Column:
        return _let(F.regexp_extract_all(norm, r["re"], F.lit(0)), lambda found: placed(r, found))

    def placed(r: Column, found: Column) -> Column:
        between = F.split(norm, r["re"], -1)
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(n_words(b).alias("skip"), n_words(f).alias("take")))
        zero = lambda before: F.struct((F.lit(0).cast("long") if before is None else before["at"]).alias("at"), nothing.alias("out"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["skip"]
            hit = F.struct(start.alias("start"), (start + s["take"]).alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"))
            return F.struct((start + s["take"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return _folded(steps, zero, step)

    hits = F.flatten(F.transform(F.filter(table, lambda r: F.exists(r["keys"], lambda k: F.contains(norm, k))), of))
    order = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"), h["confidence"].alias("confidence")))
    return F.transform(F.array_sort(order), lambda h: F.struct(h["start"].alias("start"), (-h["back"]).alias("end"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"), h["confidence"].alias("confidence")))


def unsuppressed(hits: Column) -> Column:
    """The detections that no earlier-ordered one of the same or a better priority covers."""
    none = F.array(*[F.lit(-1).cast("long")] * PRIORITIES)
    nothing = F.from_json(F.lit("[]"), F.lit(f"array<{DETECTION}>"))

    def step(acc: Column, h: Column) -> Column:
        covered = F.element_at(acc["far"], h["priority"] + 1) >= h["end"]
        far = F.transform(acc["far"], lambda e, p: F.when(p >= h["priority"], F.greatest(e, h["end"])).otherwise(e))
        return F.struct(far.alias("far"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(h))).alias("out"))

    return _folded(hits, lambda before: F.struct((none if before is None else before["far"]).alias("far"), nothing.alias("out")), step)


def scan(docs: DataFrame, text: str = "text", rule_list: list[dict] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels (array) and detections (spans of words).

    Columns of docs with these names are replaced."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections"]
    docs = docs.drop(*made)
    norm = F.col("_norm")
    gate = F.lit(False)
    for root in ROOTS:
        gate = gate | F.contains(norm, F.lit(root))
    phrases = {spaced(p): (len(p.split()), label) for p, label in BASE.items()}
    count = lambda p: ((F.length(norm) - F.length(F.replace(norm, F.lit(p), F.lit("")))) / len(p)).cast("long")
    some = lambda p: F.contains(norm, F.lit(p))
    first = [F.when(some(p), n_words(F.substring_index(norm, p, 1))) for p in phrases]
    last = [F.when(some(p), F.col("n_words") - n_words(F.substring_index(norm, p, -1)) - size) for p, (size, _) in phrases.items()]
    base = sum((F.when(some(p), count(p)).otherwise(F.lit(0).cast("long")) for p in phrases), F.lit(0).cast("long"))
    labels = F.array_sort(F.array_compact(F.array(*[F.when(some(p), F.lit(label)) for p, (_, label) in phrases.items()])))
    nothing = F.from_json(F.lit("[]"), F.lit(f"array<{DETECTION}>"))
    wide = docs.withColumn("_norm", normalised(F.col(text))).withColumn("n_words", n_words(norm)).withColumn("_gate", gate)
    return wide.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "n_words",
        F.when(F.col("_gate"), base).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(F.col("_gate"), F.least(*first)).alias("first_word"),
        F.when(F.col("_gate"), F.greatest(*last)).alias("last_word"),
        F.when(F.col("_gate"), labels).otherwise(F.array().cast("array<string>")).alias("base_labels"),
        F.when(F.col("_gate"), unsuppressed(detections(norm, rule_list))).otherwise(nothing).alias("detections"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the base places, all labels and a score, the surest kept detection's confidence."""
    found = scan(docs.select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    surest = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(surest, F.when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same scan as DuckDB SQL: rules as a table, detections as rows, suppression by windows."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({r['rule']}, {quote(r['label'])}, [{', '.join(map(quote, r['keys']))}], {r['priority']}, {r['confidence']!r}, {quote(r['re'])})" for r in rules())
    phrases = ", ".join(f"({quote(spaced(p))}, {len(p.split())}, {quote(label)})" for p, label in BASE.items())
    gate = " OR ".join(f"contains(s, {quote(r)})" for r in ROOTS)
    words = lambda s: f"CAST((length({s}) - length(replace({s}, ' ', ''))) / 2 AS BIGINT)"
    return f"""
WITH rules(rule, label, keys, priority, confidence, re) AS (VALUES {table}),
base(p, size, label) AS (VALUES {phrases}),
n AS (SELECT row_number() OVER () AS k, doc_id,
  trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS t FROM documents),
d AS (SELECT k, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS s FROM n),
b AS (SELECT k, sum(CAST((length(s) - length(replace(s, p, ''))) / length(p) AS BIGINT)) AS n_base,
    min({words("split_part(s, p, 1)")}) AS first_word,
    max({words("s")} - {words("split_part(s, p, -1)")} - size) AS last_word, list_sort(list(label)) AS labels
  FROM d, base WHERE contains(s, p) GROUP BY k),
g AS (SELECT k, s FROM d WHERE {gate}),
m AS (SELECT k, rule, label, priority, confidence, regexp_extract_all(s, re) AS f, regexp_split_to_array(s, re) AS bt FROM g, rules WHERE len(list_filter(keys, lambda x: contains(s, x))) > 0),
u AS (SELECT k, rule, label, priority, confidence, unnest(f) AS f, unnest(bt[:len(f)]) AS bt, unnest(range(len(f))) AS i FROM m WHERE len(f) > 0),
e AS (SELECT *, CAST(sum({words("bt")} + {words("f")}) OVER (PARTITION BY k, rule ORDER BY i) AS BIGINT) AS stop, {words("f")} AS size FROM u),
h AS (SELECT *, stop - size AS start FROM e),
v AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN priority <= {p} THEN stop END) OVER w, -1) AS far{p}" for p in range(PRIORITIES))} FROM h
  WINDOW w AS (PARTITION BY k ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT k, list(label) AS labels, max(confidence) AS confidence FROM v
  WHERE CASE priority {" ".join(f"WHEN {p} THEN far{p}" for p in range(PRIORITIES))} END < stop GROUP BY k)
SELECT doc_id, {words("s")} AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(c.labels, [])))), ',') AS labels,
  greatest(coalesce(confidence, 0.0), CASE WHEN n_base > 0 THEN {BASE_CONFIDENCE} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (k) LEFT JOIN c USING (k)
"""
