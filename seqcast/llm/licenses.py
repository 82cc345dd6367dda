"""Licence recognition by sentences and ordered rules over sentence identifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences by identifier, in their normal form (lower case, runs of other characters
# than letters and digits as one space). Where a published notice has a mark or a blank line in a sentence, the parts
# stand here by themselves too, as they are cut there.
SENTENCES: dict[str, str] = {
    "apache-licensed-file": "licensed under the apache license version 2 0 the license",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-obtain-at": "you may obtain a copy of the license at",
    "apache-address": "http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation "
                 "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                 "permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to "
                 "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license or at your "
                "option any later version",
    "gpl-free-program": "this program is free software",
    "gpl-free-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                      "the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the "
                "implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                "derived from this software without specific prior written permission",
    "one": "1", "two": "2", "three": "3",
    "gpl-library": "this library is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                 "software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
                  "software foundation",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2.1": "either version 2 1 of the license or at your option any later version",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-version": "2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
                 "that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
                 "warranties of merchantability and fitness",
    "spdx-tag": "spdx license identifier",
    "all-rights": "all rights reserved",
}
# The same sentences with another address.
OTHER_WORDS = {"apache-obtain": "you may obtain a copy of the license at https www apache org licenses license 2 0",
               "apache-address": "https www apache org licenses license 2 0",
               "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"}

# What licences are called in a sentence that refers to one, and how such a sentence begins.
NAMES: dict[str, Sequence[str]] = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "ISC": ("isc license",),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
}
SUBJECTS = ("", *(f"this {s} is " for s in ("project", "software", "work", "program", "library", "code", "package", "file", "repository")))
VERBS = ("released under the ", "licensed under the ", "distributed under the ", "available under the ", "made available under the ")
# Identifiers of licences as a tag names them.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "EPL-2.0", "Unlicense", "CC0-1.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "0BSD", "Zlib")


def known_sentences() -> dict[str, str]:
    """Every known sentence with its identifier: those above, references to a licence by its names, and identifiers of tags."""
    known = {sentence: name for name, sentence in (*SENTENCES.items(), *OTHER_WORDS.items())}
    known |= {f"{subject}{verb}{called}": f"refers:{license}" for license, names in NAMES.items() for called in names for subject in SUBJECTS for verb in VERBS}
    return known | {re.sub("[^a-z0-9]+", " ", license.lower()): f"spdx:{license}" for license in SPDX}

# Rules in their order of preference. A rule is a run of sentences that follow each other.
RULES: dict[str, tuple[str, Sequence[str]]] = {
    "apache-2.0-header": ("Apache-2.0", ("refers:Apache-2.0", "apache-may-not-use", "apache-obtain", "apache-as-is", "apache-see")),
    "apache-2.0-notice": ("Apache-2.0", ("apache-licensed-file", "apache-may-not-use", "apache-obtain", "apache-as-is", "apache-see")),
    # Where the notice ends its first sentence with a semicolon, and its address stands apart.
    "apache-2.0-notice-lines": ("Apache-2.0", ("apache-licensed-file", "apache-may-not-use", "apache-obtain-at", "apache-address",
                                               "apache-as-is", "apache-see")),
    "apache-2.0-header-lines": ("Apache-2.0", ("refers:Apache-2.0", "apache-may-not-use", "apache-obtain-at", "apache-address",
                                               "apache-as-is", "apache-see")),
    "mit-text": ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    "gpl-3.0-notice": ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    "gpl-3.0-notice-cut": ("GPL-3.0-or-later", ("gpl-free-program", "gpl-free-terms", "gpl-hope-useful", "gpl-hope-implied")),
    "mit-text-start": ("MIT", ("mit-grant", "mit-notice")),
    "apache-2.0-file": ("Apache-2.0", ("apache-licensed-file",)),
    "gpl-3.0-free": ("GPL-3.0-or-later", ("gpl-free",)),
    "gpl-3.0-free-cut": ("GPL-3.0-or-later", ("gpl-free-program", "gpl-free-terms")),
    "gpl-3.0-terms": ("GPL-3.0-or-later", ("gpl-free-terms",)),
    "cc-by-nc-4.0-reference": ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    "cc-by-4.0-reference": ("CC-BY-4.0", ("cc-by-4",)),
    "cc-by-sa-4.0-reference": ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    "bsd-notice": ("BSD", ("all-rights", "bsd-redistribution")),
    "bsd-start": ("BSD", ("bsd-redistribution",)),
    "all-rights-reserved": ("All-Rights-Reserved", ("all-rights",)),
    "bsd-3-text": ("BSD-3-Clause", ("bsd-redistribution", "one", "bsd-source", "two", "bsd-binary", "three", "bsd-name")),
    "bsd-3-text-unnumbered": ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    "bsd-2-text": ("BSD-2-Clause", ("bsd-redistribution", "one", "bsd-source", "two", "bsd-binary")),
    "bsd-2-text-unnumbered": ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    "gpl-2.0-notice": ("GPL-2.0-or-later", ("gpl-free-program", "gpl-terms", "either-2", "gpl-hope-useful", "gpl-hope-implied")),
    "gpl-2.0-free": ("GPL-2.0-or-later", ("gpl-free-program", "gpl-terms", "either-2")),
    "lgpl-2.1-notice": ("LGPL-2.1-or-later", ("gpl-library", "lgpl-terms", "either-2.1")),
    "lgpl-3.0-notice": ("LGPL-3.0-or-later", ("lgpl3-terms",)),
    "agpl-3.0-notice": ("AGPL-3.0-or-later", ("agpl3-terms",)),
    "mpl-2.0-notice": ("MPL-2.0", ("mpl-subject", "mpl-version", "mpl-copy")),
    "isc-text": ("ISC", ("isc-grant", "isc-as-is")),
    "isc-grant": ("ISC", ("isc-grant",)),
    **{f"{license.lower()}-reference": (license, (f"refers:{license}",)) for license in NAMES},
    **{f"spdx-{license.lower()}": (license, ("spdx-tag", f"spdx:{license}")) for license in SPDX},
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A mark that ends a sentence, and the white space of its line after it.
LONG_WORD = 6
SENTENCE_END = r"([.!?;:])(?:[ \t\r\x0B\x0C]+|(?=\n))"


def normal_lines(text: Column) -> Column:
    """The text's lines, normalised; an empty line follows a mark that ends a sentence."""
    lower = F.translate(text, UPPER, LOWER)
    words = F.regexp_replace(F.regexp_replace(lower, SENTENCE_END, "$1\n\n"), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(words, " ?\n ?", "\n")


def anchors(known: Mapping[str, str], rules: Mapping[str, tuple[str, Sequence[str]]]) -> list[str]:
    """A few words of which every text that a rule matches has one: for each rule, a word of all the ways to say one of its sentences."""
    said: dict[str, list[set[str]]] = {}
    for sentence, name in known.items():
        said.setdefault(name, []).append(set(sentence.split(" ")))
    # Words that stand in whatever way a sentence of the rule is said.
    open_rules = [set.union(*(set.intersection(*said[name]) for name in run)) for _, run in rules.values()]
    # Short words stand in too many texts.
    open_rules = [{w for w in words if len(w) >= LONG_WORD} or words for words in open_rules]
    chosen: list[str] = []
    while open_rules:
        count = Counter(word for words in open_rules for word in words)
        # The word of most rules; of equals the longest, which fewest texts have.
        best = max(count, key=lambda word: (count[word], len(word), word))
        chosen.append(best)
        open_rules = [words for words in open_rules if best not in words]
    return chosen


def _known_runs(known: Mapping[str, str]) -> Column:
    """For each line of each of ``paragraphs``: its place, and of the most lines from it on that say a known sentence how many they are and the sentence.

    The lists become sets, so a look into them takes as long whatever their length.
    """
    first_words = ", ".join(sorted({f"'{sentence.split(' ')[0]}'" for sentence in known}))
    every = ", ".join(f"'{sentence}'" for sentence in known)
    most = max(sentence.count(" ") + 1 for sentence in known)
    return F.expr(f"""
        transform(paragraphs, l -> transform(sequence(1, size(l)), i -> named_struct('at', i, 'known',
            CASE WHEN split(l[i - 1], ' ')[0] IN ({first_words}) THEN
                array_max(transform(filter(sequence(1, least({most}, size(l) - i + 1)), k -> array_join(slice(l, i, k), ' ') IN ({every})),
                                    k -> named_struct('lines', k, 'said', array_join(slice(l, i, k), ' ')))) END)))""")


# Lines that a known sentence takes, but for its first, are no sentences.
WHOLE = """
    transform(runs, p -> filter(p, s -> NOT exists(p, before -> before.at < s.at AND before.at + coalesce(before.known.lines, 0) > s.at)))"""


def _numbered(known: Mapping[str, str], numbers: Mapping[str, int]) -> Column:
    """The sentences' numbers in order, 0 for unknown ones. Only known ones are looked up."""
    said, meant = "\n".join(known), "\n".join(str(numbers[name]) for name in known.values())
    of = F.map_from_arrays(F.split(F.lit(said), "\n"), F.split(F.lit(meant), "\n").cast("array<int>"))
    return F.transform(F.flatten("whole"), lambda s: F.when(s["known"].isNotNull(), of[s["known"]["said"]]).otherwise(0))


def license_matches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    known: Mapping[str, str] | None = None,
                    rules: Mapping[str, tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """Licence mentions in documents, a row each: the id, ``license, rule, first_sentence, n_sentences``.

    A text is split into normalised sentences, each is mapped to its number among the known
    ones (0 if unknown; ``known`` gives each sentence's identifier), and the numbers are matched against the rules: a rule matches where its
    sentences follow each other with nothing between. At a place the longest rule wins, the earlier of equals; a match
    inside a longer one is left out. ``first_sentence`` counts the text's sentences from 1.

    A line end ends a sentence, and so does [.!?;:] before white space. But lines with neither such a mark nor an
    empty line between them that together say a known sentence are one sentence, the most lines from one on, so a notice is found however it is wrapped,
    and behind the comment signs of source code.

    All of it is expressions within a row, so nothing is shuffled and a task holds one
    document at a time. A few words, of which every rule needs one, say which documents are split; a document without any has no match. Lines are looked up in
    sets of the known sentences' first words and of the sentences, so the time does not grow with their number. Very long texts are split whole.
    Null or empty text has no match; repeated rows and null ids each give
    their own matches; an empty table gives no rows; other columns are ignored.
    """
    known = known_sentences() if known is None else known
    numbers = {name: i + 1 for i, name in enumerate(dict.fromkeys(known.values()))}
    ranked = sorted(rules.items(), key=lambda r: -len(r[1][1]))
    patterns = F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(license).alias("license"),
                 F.array(*(F.lit(numbers[s]) for s in run)).alias("run")) for rule, (license, run) in ranked))
    lower = F.lower(F.col(text_column))
    has_any = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(word)) for word in anchors(known, rules)])
    found = (docs.filter(has_any).select(F.col(id_column).alias("id"), normal_lines(F.col(text_column)).alias("lines"))
             .select("id", F.filter(F.transform(F.split("lines", "\n\n+"), lambda p: F.filter(F.split(F.trim(p), "\n"), lambda s: s != "")),
                                    lambda p: F.size(p) > 0).alias("paragraphs"))
             .select("id", _known_runs(known).alias("runs"))
             .filter(F.exists("runs", lambda p: F.exists(p, lambda s: s["known"].isNotNull())))
             .select("id", F.expr(WHOLE).alias("whole")).select("id", _numbered(known, numbers).alias("seq")))

    def at(i: Column) -> Column:
        fits = F.filter(patterns, lambda p: F.slice(F.col("seq"), i, F.size(p["run"])) == p["run"])
        return F.transform(F.slice(fits, 1, 1), lambda p: F.struct(
            i.alias("first"), F.size(p["run"]).alias("n"), p["rule"].alias("rule"), p["license"].alias("license")))

    starts = F.filter(F.sequence(F.lit(1), F.size("seq")), lambda i: F.element_at(F.col("seq"), i) > 0)
    matches = found.select("id", F.flatten(F.transform(starts, at)).alias("m"))
    outer = F.filter("m", lambda x: ~F.exists("m", lambda o: (o["first"] < x["first"])
                                              & (o["first"] + o["n"] >= x["first"] + x["n"])))
    return (matches.select("id", F.explode(outer).alias("x"))
            .select(F.col("id").alias(id_column), "x.license", "x.rule", F.col("x.first").cast("long").alias("first_sentence"),
                    F.col("x.n").cast("long").alias("n_sentences")))
