"""Licence recognition by sentence rules.

Marks of comments at the beginning of lines are taken away, and a text is cut into sentences at blank lines, around lines
with an SPDX tag, and after ``.``, ``!`` or ``?`` before white space, but not after a single letter and a dot (``v. 2``).
A single line feed is a space, so hard-wrapped licences read like unwrapped ones. A sentence is normalised: lower-cased,
every run of characters other than letters, digits and dots made one space, trimmed of spaces and dots.

Known sentences are looked up in a table of normalised texts. A sentence of a licence's body counts wherever it stands
whole in a normalised sentence, since names, years and list numbers may stand around it. A licence's name counts if it is
the whole sentence or if words that refer to a licence come before it, unless they are denied (``not licensed under``).
A known text inside a longer known text does not count. The identifiers of a document, in order, are then matched against ordered rules: a rule is a sequence of
identifiers that must follow one another, other known sentences only in between if it says so; rules are tried in order,
the longer before the shorter, and the identifiers that a rule uses are not used again. A whole licence goes from its
title to its last known sentence and uses all between, so that licences which it mentions, and the notices that it shows as
examples, do not count; no such rule reaches over the title of another licence. A title without its end still counts, and so
does what is mentioned after it.

All of it runs in the JVM; only sentences that hold one of the fixed ``CUES`` are looked up.

Nulls and empty texts have no sentences and so no licence. Repeated rows give repeated rows; a null doc_id is kept. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licences and their names, normalised, in the order in which they are tried.
NAMES: tuple[tuple[str, ...], ...] = (
    ("Apache-2.0", "apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache license v2", "apache software license version 2.0", "apache software license 2.0", "apache 2.0", "apache 2"),
    ("Apache-1.1", "apache software license version 1.1", "apache software license 1.1", "apache 1.1"),
    ("Apache", "apache license", "apache software license"),
    ("MIT", "mit license", "mit licence", "expat license", "mit x11 license", "mit"),
    ("MIT-0", "mit no attribution license", "mit no attribution", "mit 0"),
    ("X11", "x11 license"),
    ("BSD-2-Clause", "bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    ("BSD-3-Clause", "bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"),
    ("BSD-4-Clause", "bsd 4 clause license", "4 clause bsd license", "original bsd license", "bsd 4 clause"),
    ("0BSD", "zero clause bsd license", "bsd zero clause license", "0bsd"),
    ("BSD", "bsd license", "bsd licence", "bsd style license", "bsd"),
    ("ISC", "isc license", "isc licence", "isc"),
    ("MPL-2.0", "mozilla public license version 2.0", "mozilla public license v. 2.0", "mozilla public license v2.0", "mozilla public license 2.0", "mpl 2.0"),
    ("MPL-1.1", "mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1"),
    ("EPL-2.0", "eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license v. 2.0", "eclipse public license v 2.0", "eclipse public license 2.0", "epl 2.0"),
    ("EPL-1.0", "eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license v 1.0", "eclipse public license 1.0", "epl 1.0"),
    ("CDDL-1.0", "common development and distribution license version 1.0", "common development and distribution license", "cddl 1.0", "cddl"),
    ("CPL-1.0", "common public license version 1.0", "common public license", "cpl 1.0"),
    ("IPL-1.0", "ibm public license version 1.0", "ibm public license"),
    ("EUPL-1.2", "european union public licence version 1.2", "european union public license version 1.2", "european union public licence v. 1.2", "eupl version 1.2", "eupl 1.2"),
    ("EUPL-1.1", "european union public licence version 1.1", "european union public license version 1.1", "eupl 1.1"),
    ("Artistic-2.0", "artistic license version 2.0", "artistic license 2.0", "artistic 2.0"),
    ("Artistic-1.0", "artistic license version 1.0", "artistic license 1.0", "artistic license", "artistic 1.0"),
    ("BSL-1.0", "boost software license version 1.0", "boost software license 1.0", "boost software license", "bsl 1.0"),
    ("BUSL-1.1", "business source license version 1.1", "business source license 1.1", "business source license", "busl 1.1"),
    ("SSPL-1.0", "server side public license version 1", "server side public license", "sspl 1.0"),
    ("Elastic-2.0", "elastic license 2.0", "elastic license version 2.0", "elastic license", "elastic 2.0"),
    ("Zlib", "zlib license", "zlib libpng license", "zlib"),
    ("Libpng", "libpng license", "libpng 2.0"),
    ("Unlicense", "unlicense"),
    ("WTFPL", "do what the fuck you want to public license", "wtfpl"),
    ("CC0-1.0", "cc0 1.0 universal", "cc0 1.0", "creative commons zero", "creative commons cc0", "cc0"),
    ("CC-BY-NC-SA", "cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"),
    ("CC-BY-NC-ND", "cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"),
    ("CC-BY-NC", "cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    ("CC-BY-SA", "cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    ("CC-BY-ND", "cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"),
    ("CC-BY", "cc by", "creative commons attribution"),
    ("GFDL-1.3", "gnu free documentation license version 1.3", "gnu fdl 1.3", "gfdl 1.3"),
    ("GFDL-1.2", "gnu free documentation license version 1.2", "gnu fdl 1.2", "gfdl 1.2"),
    ("GFDL-1.1", "gnu free documentation license version 1.1", "gnu fdl 1.1", "gfdl 1.1"),
    ("GFDL", "gnu free documentation license", "gnu fdl", "gfdl"),
    ("OFL-1.1", "sil open font license version 1.1", "sil open font license", "open font license", "ofl 1.1"),
    ("PSF-2.0", "python software foundation license version 2", "python software foundation license", "psf license", "psf 2.0"),
    ("Python-2.0", "python license", "python 2.0"),
    ("PHP-3.01", "php license version 3.01", "php license", "php 3.01"),
    ("Ruby", "ruby license", "ruby"),
    ("OpenSSL", "openssl license"),
    ("PostgreSQL", "postgresql license", "postgresql licence", "postgresql"),
    ("NCSA", "university of illinois ncsa open source license", "university of illinois open source license", "ncsa"),
    ("OSL-3.0", "open software license version 3.0", "open software license 3.0", "open software license", "osl 3.0"),
    ("AFL-3.0", "academic free license version 3.0", "academic free license", "afl 3.0"),
    ("MS-PL", "microsoft public license", "ms pl"),
    ("MS-RL", "microsoft reciprocal license", "ms rl"),
    ("MulanPSL-2.0", "mulan permissive software license version 2", "mulan psl v2", "mulanpsl 2.0"),
    ("QPL-1.0", "q public license version 1.0", "q public license", "qpl 1.0"),
    ("Vim", "vim license"),
    ("Sleepycat", "sleepycat license"),
    ("NASA-1.3", "nasa open source agreement version 1.3", "nasa open source agreement", "nasa 1.3"),
    ("ECL-2.0", "educational community license version 2.0", "educational community license", "ecl 2.0"),
    ("UPL-1.0", "universal permissive license version 1.0", "universal permissive license", "upl 1.0"),
    ("CeCILL-2.1", "cecill free software license agreement", "cecill license", "cecill 2.1"),
    ("LPPL-1.3c", "latex project public license version 1.3c", "latex project public license", "lppl 1.3c"),
    ("ODbL-1.0", "open database license", "odbl 1.0", "odbl"),
    ("ODC-By-1.0", "open data commons attribution license", "odc by 1.0"),
    ("PDDL-1.0", "public domain dedication and license", "pddl 1.0"),
    ("W3C", "w3c software notice and license", "w3c software license", "w3c"),
    ("Hippocratic-2.1", "hippocratic license version 2.1", "hippocratic license", "hippocratic 2.1"),
    ("BlueOak-1.0.0", "blue oak model license", "blueoak 1.0.0"),
    ("JSON", "json license"),
    ("Beerware", "beer ware license", "beerware license", "beerware"),
)

# The GNU licences, their versions and names. ``GNU_TAIL`` reads a version after such a name.
GNU: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("AGPL", ("3.0", "1.0"), ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl")),
    ("LGPL", ("3.0", "2.1", "2.0"), ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl")),
    ("GPL", ("3.0", "2.0", "1.0"), ("gnu general public license", "gnu gpl", "gpl")),
)
GNU_TAIL = r"^ (?:as published by the free software foundation )?(?:either )?(?:version |v ?\.? ?)?([123](?:\.[01])?) (?:of the license )?(?:or (?:at your option )?(?:any )?(later|newer)|(only))?"

# Sentences of licences' bodies, normalised, or the part of them that never changes.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apacheterms", "you may not use this file except in compliance with the license"),
    ("apachecopy", "you may obtain a copy of the license at"),
    ("apacheasis", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mitnotice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("asis", "the software is provided as is without warranty of any kind"),
    ("iscgrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("iscgrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zerogrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("iscasis", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("iscasis", "the software is provided as is and isc disclaims all warranties with regard to this software"),
    ("bsdgrant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsdsource", "redistributions of source code must retain the above copyright notice"),
    ("bsdbinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsdadvert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsdendorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdasis", "this software is provided by the copyright holders and contributors as is"),
    ("bsdasis", "this software is provided by the author and contributors as is"),
    ("bsdasis", "this software is provided by the regents and contributors as is"),
    ("bsdasis", "this software is provided by the author as is"),
    ("gnufree", "is free software you can redistribute it and or modify it"),
    ("gnuwarranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnureceived", "you should have received a copy of the"),
    ("mplform", "this source code form is subject to the terms of the"),
    ("mplcopy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlibasis", "this software is provided as is without any express or implied warranty"),
    ("zlibgrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zliborigin", "the origin of this software must not be misrepresented"),
    ("zlibmarked", "altered source versions must be plainly marked as such"),
    ("zlibnotice", "this notice may not be removed or altered from any source distribution"),
    ("boostgrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicensefree", "this is free and unencumbered software released into the public domain"),
    ("unlicensegrant", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("publicdomain", "dedicated to the public domain"),
    ("wtfpldo", "you just do what the fuck you want to"),
    ("epltext", "this program and the accompanying materials are made available under the terms of the"),
    ("oflfont", "this font software is licensed under the sil open font license"),
    ("gnuinstead", "if this is what you want to do use the gnu lesser general public license instead of this license"),
    ("gnuinstead", "if this is what you want to do use the gnu library general public license instead of this license"),
    ("gnuwaiver", "an absolute waiver of all civil liability in connection with the program"),
    ("gnudisclaim", "hereby disclaims all copyright interest in the"),
    ("gnuproxy", "if the library as you received it specifies that a proxy can decide whether future versions of the"),
    ("agplsee", "for more information on this and how to apply and follow the gnu agpl see"),
    ("gfdlcode", "if your document contains nontrivial examples of program code we recommend releasing these examples in parallel under your choice of free software license such as the gnu general public license to permit their use in free software"),
    ("mplmeans", "incompatible with secondary licenses means"),
    ("mplincompatible", "this source code form is incompatible with secondary licenses as defined by the"),
    ("mpllarger", "larger work means a work which combines covered code or portions thereof with code not governed by the terms of this license"),
    ("mpleither", "if you do not delete the provisions above a recipient may use your version of this file under either the mpl"),
    ("eplagreement", "the accompanying program is provided under the terms of this eclipse public license"),
    ("eplsimply", "simply including a copy of this agreement including this exhibit a is not sufficient to license the source code under secondary licenses"),
    ("artisticintent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artisticasis", "this package is provided as is and without any express or implied warranties"),
    ("copyrightc", "copyright c"),
    ("allrights", "all rights reserved"),
)

# Whole licences: the title and date at their head, normalised, and the sentences that may end them.
WHOLE: tuple[tuple[str, str, str], ...] = (
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", "agplsee gnuwaiver"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", "gnuinstead gnuwaiver"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", "gnuinstead gnudisclaim"),
    ("GPL-1.0", "gnu general public license version 1 february 1989", "gnudisclaim"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", "gnuproxy"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999", "gnudisclaim"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991", "gnudisclaim"),
    ("GFDL-1.3", "gnu free documentation license version 1.3 3 november 2008", "gfdlcode"),
    ("GFDL-1.2", "gnu free documentation license version 1.2 november 2002", "gfdlcode"),
    ("GFDL-1.1", "gnu free documentation license version 1.1 march 2000", "gfdlcode"),
    ("Apache-2.0", "apache license version 2.0 january 2004", "apacheasis"),
)

# Ordered rules of bodies. A rule's parts follow one another; "*" lets other known sentences stand between.
BODY_RULES: tuple[tuple[str, str], ...] = (
    ("BSD-4-Clause", "bsdgrant bsdsource bsdbinary bsdadvert bsdendorse bsdasis"),
    ("BSD-3-Clause", "bsdgrant bsdsource bsdbinary bsdendorse bsdasis"),
    ("BSD-2-Clause", "bsdgrant bsdsource bsdbinary bsdasis"),
    ("MIT", "mitgrant mitnotice asis"),
    ("MIT-0", "mitgrant asis"),
    ("BSL-1.0", "boostgrant * asis"),
    ("ISC", "iscgrant iscasis"),
    ("0BSD", "zerogrant iscasis"),
    ("Zlib", "zlibasis zlibgrant zliborigin zlibmarked zlibnotice"),
    ("Unlicense", "unlicensefree unlicensegrant"),
    ("Unlicense", "unlicensefree"),
    ("WTFPL", "wtfpldo"),
    ("CC0-1.0", "publicdomain"),
)

# Every known sentence holds one of these, and one of those comes before a licence's name.
CUES = ("licen", "permi", "copyright", "rights reserved", "warrant", "redistribut", "endorse", "provided", "public domain", "cc0", "creative commons", "as is", "as-is", "as\nis", "cc by", "cc-by", "gpl", "mentioning", "misrepresented", "plainly marked", "this notice", "free software", "open source", "mpl", "anyone is free", "just do what")
REFERRING = r" (under|subject to|terms of|terms and conditions of|governed by|covered by|identifier|received a copy of|licen[sc]e is|licen[sc]es?)( [a-z0-9.]+){0,6} $"

# What denies such words. Between them and the name only these stand.
DENIED = r" (not|never|no longer|isn t|aren t|wasn t|weren t)( be| been| being| licen[sc]ed| released| distributed| redistributed| published| provided| offered| available| made| now){0,3} (under|subject to|governed by|covered by)( the| a| an| any| terms| conditions| and| of){0,6} $"


def ident(spdx: str) -> str:
    return "ref" + "".join(c for c in spdx.lower() if c.isalnum())


def title(spdx: str) -> str:
    """The identifier of a whole licence's title; the hyphen in it keeps rules from reaching over it."""
    return f"title-{ident(spdx)[3:]}"


def gnu_versions() -> list[tuple[str, str]]:
    """(licence, family) of every GNU licence, by rule."""
    return [(f"{family}-{v}{tail}", family) for family, versions, _ in GNU for v in versions for tail in ("-or-later", "-only", "")]


def known_texts() -> list[tuple[str, str, str]]:
    """(identifier, normalised text, kind: sentence, name or gnu) of everything that is looked up."""
    named = [(ident(spdx), name, "name") for spdx, *names in NAMES for name in names]
    titles = [(title(spdx), text, "sentence") for spdx, text, _ in WHOLE]
    return titles + [(i, text, "sentence") for i, text in SENTENCES] + named + [(ident(family), name, "gnu") for family, _, names in GNU for name in names]


def rules() -> list[tuple[str, str]]:
    """(licence, rule) in order: whole licences, bodies, then the Apache and Mozilla notices around a name, then names alone."""
    spdx = [*dict.fromkeys(row[0] for row in NAMES), *(i for i, _ in gnu_versions()), *(family for family, _, _ in GNU)]
    notices = [("Apache-2.0", f"{ident('Apache-2.0')} apacheterms apachecopy * apacheasis"), ("MPL-2.0", f"mplform {ident('MPL-2.0')} mplcopy")]
    # a warranty notice names the licence anew, without a version
    later = [(s, f"{ident(s)} gnuwarranty gnureceived {ident(family)}") for s, family in gnu_versions()]
    ended = [(s, f"{title(s)} * {end}") for s, _, ends in WHOLE for end in ends.split()]
    headed = [
        ("MPL-2.0", f"{ident('MPL-2.0')} mplmeans * mplincompatible {ident('MPL-2.0')}"),
        ("MPL-1.1", f"{ident('MPL-1.1')} mpllarger * mpleither"),
        ("EPL-2.0", f"{ident('EPL-2.0')} eplagreement * eplsimply"),
        ("EPL-2.0", f"{ident('EPL-2.0')} eplagreement"),
        ("EPL-1.0", f"{ident('EPL-1.0')} eplagreement"),
        ("Artistic-1.0", "artisticintent * artisticasis"),
        ("Artistic-1.0", "artisticintent"),
    ]
    begun = [(s, title(s)) for s, _, _ in WHOLE]
    return [*ended, *headed, *begun, *BODY_RULES, *notices, *later, *((s, ident(s)) for s in spdx)]


_MARKS = r"(?m)^[ \t]*(?:(?:#+|//+|/\*+|\*+/?|--+|;+|%+|dnl\b|REM\b)[ \t]*)?"
_TAG_LINE = r"(?im)^(.*spdx-license-identifier:.*)$"
_CUT = r"\n[ \t\r]*\n[\x20\x09-\x0D]*|(?<=[.!?])(?<![ (][A-Za-z]\.)[\x20\x09-\x0D]+"


def sentences(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, _MARKS, ""), _TAG_LINE, "\n\n$1\n\n")
    return F.split(plain, _CUT, -1)


def normalised(sentence: Column) -> Column:
    """A normalised sentence, with a space before and behind."""
    spaced = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}.]+", " ")
    return F.concat(F.lit(" "), F.regexp_replace(spaced, r"^[ .]+|[ .]+$", ""), F.lit(" "))


def cued(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found = found | F.contains(low, F.lit(cue))
    return found


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sentence_ids(norm: Column) -> Column:
    """The identifiers of the known texts in a normalised sentence, in order."""
    texts = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(f" {t} ").alias("text"), F.lit(len(t)).alias("size"), F.lit(kind).alias("kind")) for i, t, kind in known_texts()))

    def placed(k: Column) -> Column:
        return F.struct(F.call_function("instr", norm, k["text"]).alias("at"), k["size"].alias("size"), k["id"].alias("id"), k["kind"].alias("kind"))

    def meant(k: Column) -> Column:
        before = F.substr(norm, F.lit(1), k["at"])
        return (k["kind"] == "sentence") | (F.length(norm) == k["size"] + 2) | (before.rlike(REFERRING) & ~before.rlike(DENIED))

    def outer(k: Column, others: Column) -> Column:
        return ~F.exists(others, lambda o: (o["at"] <= k["at"]) & (o["at"] + o["size"] >= k["at"] + k["size"]) & (o["size"] > k["size"]))

    def versioned(k: Column) -> Column:
        tail = F.substr(norm, k["at"] + k["size"] + 1)
        number, later, only = (F.regexp_extract(tail, GNU_TAIL, i) for i in (1, 2, 3))
        digits = F.when(number == "", "").when(F.contains(number, F.lit(".")), F.replace(number, F.lit("."), F.lit(""))).otherwise(F.concat(number, F.lit("0")))
        return F.when(k["kind"] == "gnu", F.concat(k["id"], digits, F.when(later != "", "orlater").otherwise(only))).otherwise(k["id"])

    found = F.filter(F.transform(F.filter(texts, lambda k: F.contains(norm, k["text"])), placed), meant)
    return let(found, lambda every: F.transform(F.array_sort(F.filter(every, lambda k: outer(k, every))), versioned))


def rule_pattern(rule: str) -> str:
    """A rule as a pattern over identifiers that each have a space before and behind; ``*`` passes over no title."""
    return "".join(r"(?: [a-z0-9]+ )*?" if part == "*" else f" {part} " for part in rule.split())


def licenses_of(ids: Column) -> Column:
    """The licences of an array of identifiers in order: each rule takes what it matches, and leaves a mark in its place."""
    left = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    state = F.struct(left.alias("left"), F.array().cast("array<string>").alias("found"))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(rule)).alias("pattern"), F.lit(f" {rule.split()[0]} ").alias("first")) for name, rule in rules()))

    def take(at: Column, rule: Column) -> Column:
        hit = F.contains(at["left"], rule["first"]) & (F.regexp_instr(at["left"], rule["pattern"]) > 0)
        return F.struct(
            F.when(hit, F.regexp_replace(at["left"], rule["pattern"], F.lit(" . "))).otherwise(at["left"]).alias("left"),
            F.when(hit, F.array_union(at["found"], F.array(rule["name"]))).otherwise(at["found"]).alias("found"),
        )

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(table, state, take, lambda at: at["found"]))


def license_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_known (known licence sentences), sentence_ids and licenses (names in the order of the rules, joined by commas)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = F.flatten(F.transform(F.transform(F.filter(sentences(F.col("text")), cued), normalised), sentence_ids))
    none = F.array().cast("array<string>")
    out = docs.select("doc_id", F.when(cued(F.col("text")), ids).otherwise(none).alias("ids"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licenses_of(F.col("ids")), ",").alias("licenses"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    """The tables of fixed values, and the steps as joins: sentences with known texts, then the rules in a recursion."""
    texts = ", ".join(f"({_quoted(i)}, {_quoted(f' {t} ')}, {len(t)}, {_quoted(k)})" for i, t, k in known_texts())
    table = ", ".join(f"({n}, {_quoted(name)}, {_quoted(rule_pattern(rule))})" for n, (name, rule) in enumerate(rules()))
    return rf"""
WITH RECURSIVE known(id, t, size, kind) AS (VALUES {texts}), rule(n, name, p) AS (VALUES {table}),
plain AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_replace(regexp_replace(coalesce(text, ''), {_quoted(_MARKS)}, '', 'g'), {_quoted(_TAG_LINE)}, chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS x FROM documents
), cut AS (
  SELECT rid, string_split(regexp_replace(regexp_replace(regexp_replace(x, '\n[ \t\r]*\n[\x20\x09-\x0D]*', chr(2), 'g'), '([ (][A-Za-z]\.)[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(2), 'g'), chr(2)) AS s FROM plain
), sentence AS (
  SELECT rid, i, ' ' || regexp_replace(regexp_replace(lower(s[i]), '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') || ' ' AS norm
  FROM cut, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE regexp_matches(lower(s[i]), {_quoted('|'.join(CUES))})
), hit AS (
  SELECT rid, i, norm, id, kind, size, instr(norm, t) AS pos FROM sentence JOIN known ON contains(norm, t)
  WHERE kind = 'sentence' OR length(norm) = size + 2 OR (regexp_matches(substr(norm, 1, instr(norm, t)), {_quoted(REFERRING)}) AND NOT regexp_matches(substr(norm, 1, instr(norm, t)), {_quoted(DENIED)}))
), kept AS (
  SELECT *, regexp_extract(substr(norm, pos + size + 1), {_quoted(GNU_TAIL)}, ['v', 'l', 'o']) AS g FROM hit h
  WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.rid = h.rid AND o.i = h.i AND o.pos <= h.pos AND o.pos + o.size >= h.pos + h.size AND o.size > h.size)
), named AS (
  SELECT rid, list(CASE WHEN kind = 'gnu' THEN id || CASE WHEN g.v = '' THEN '' WHEN contains(g.v, '.') THEN replace(g.v, '.', '') ELSE g.v || '0' END || CASE WHEN g.l <> '' THEN 'orlater' ELSE g.o END ELSE id END ORDER BY i, pos, size, id) AS ids
  FROM kept GROUP BY rid
), walk AS (
  SELECT rid, -1 AS n, ' ' || array_to_string(ids, '  ') || ' ' AS l, CAST([] AS VARCHAR[]) AS f FROM named
  UNION ALL
  SELECT rid, rule.n, regexp_replace(l, p, ' . ', 'g'), CASE WHEN regexp_matches(l, p) AND NOT list_contains(f, name) THEN list_append(f, name) ELSE f END
  FROM walk JOIN rule ON rule.n = walk.n + 1
)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(f, ','), '') AS licenses
FROM plain LEFT JOIN named USING (rid) LEFT JOIN (SELECT rid, f FROM walk WHERE n = (SELECT max(n) FROM rule)) w USING (rid)
"""


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {"op4_license_scan": _oracle()}
