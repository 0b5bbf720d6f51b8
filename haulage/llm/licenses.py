r"""Licence scans by sentence-rule recognition.

A text is cut into sentences, each is normalised (lower case, everything but
letters and digits is one space) and mapped to the identifier of a known
licence sentence. The identifiers of a document in order are then matched
against the licence rules, also in order: a rule is a sequence of identifiers
that must follow each other, others between them allowed. A rule that matches
uses its identifiers up, so a general rule doesn't report again what a more
specific one before it has recognised.

Only DataFrame functions are used. The known sentences are a fixed table (see
``SENTENCES``) that is broadcast; only matching sentences leave the scan.

Sentences end at . ; ! ? before white space or the text's end, and at empty
lines; a line feed inside a sentence is a space, and each of its lines is also
tried by itself, so both wrapped licence texts and one-line notices are found.

Defined results: a null or empty text has no licence; a document without
known sentences has empty lists; a repeated row gets a row of its own; other
columns are ignored; whole texts of any length are scanned; of rules that
want the same sentence (ties) the earlier one has it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence sentences, normalised, and their identifiers (fixed values).
SENTENCES = [
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "spdx license identifier mit"),
    ("mit-name", "the mit license mit"),
    ("mit-name", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions the above copyright notice and this permission notice shall be included in "
                  "all copies or substantial portions of the software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not "
              "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-name", "licensed under the apache license version 2 0"),
    ("apache-name", "licensed under the apache license version 2 0 the license"),
    ("apache-name", "released under the apache license version 2 0"),
    ("apache-name", "spdx license identifier apache 2 0"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl2-name", "this work is licensed under the gnu general public license version 2"),
    ("gpl2-name", "spdx license identifier gpl 2 0 only"),
    ("gpl2-name", "spdx license identifier gpl 2 0 or later"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl3-name", "spdx license identifier gpl 3 0 only"),
    ("gpl3-name", "spdx license identifier gpl 3 0 or later"),
    ("gpl2-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version 2 of the "
                   "license or at your option any later version"),
    ("gpl3-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version 3 of the "
                   "license or at your option any later version"),
    ("gpl-free", "this program is free software"),
    ("gpl2-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation"),
    ("gpl2-either", "either version 2 of the license or at your option any later version"),
    ("gpl3-either", "either version 3 of the license or at your option any later version"),
    ("lgpl-name", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-name", "spdx license identifier lgpl 3 0 only"),
    ("mpl-name", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-name", "spdx license identifier mpl 2 0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and "
                   "the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                   "and the following disclaimer in the documentation and or other materials provided with the "
                   "distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission"),
    ("bsd2-name", "spdx license identifier bsd 2 clause"),
    ("bsd3-name", "spdx license identifier bsd 3 clause"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                  "hereby granted provided that the above copyright notice and this permission notice appear in all "
                  "copies"),
    ("isc-name", "spdx license identifier isc"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-name", "spdx license identifier cc0 1 0"),
    ("cc0-name", "licensed under cc0 1 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("rights", "all rights reserved"),
]

#: Licence rules, the more specific first (fixed values).
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-name", "apache-use", "apache-copy"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "as-is"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl2-either"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl2-terms", "gpl3-either"]),
    ("Apache-2.0", ["apache-name"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-name"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0", ["gpl2-name"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("LGPL-3.0", ["lgpl-name"]),
    ("MPL-2.0", ["mpl-name"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-name"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("All rights reserved", ["rights"]),
]

_END = r"[.;!?]+(?=\s|\z)|\n[ \t\r]*\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(docs: DataFrame) -> DataFrame:
    """__k1, __k2, place, sentence (normalised) of every sentence, and of
    every line of a sentence that has several."""
    parts = docs.select("__k1", "__k2", F.posexplode(F.split("text", _END)).alias("n", "raw"))
    trimmed = F.trim(F.col("raw"), F.lit(" \t\r\n"))
    lines = F.when(F.contains(trimmed, F.lit("\n")), F.split(trimmed, "\n")).otherwise(F.array().cast("array<string>"))
    rows = parts.select("__k1", "__k2", "n", F.posexplode(F.concat(F.array(trimmed), lines)).alias("line", "raw"))
    return rows.select("__k1", "__k2", F.struct("n", "line").alias("place"), normalised(F.col("raw")).alias("sentence"))


def known_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in SENTENCES], "sentence string, id string")


def _pattern(ids: list[str]) -> str:
    """A rule as a pattern over the identifiers, each between two commas; the
    identifiers between stay for later rules."""
    return "".join(f"{'(.*?)' if n else ''},{i}," for n, i in enumerate(ids))


def match_rules(ids: Column) -> Column:
    """The licences that the rules find, in the order of the rules, each once.
    ids: array of identifiers in the document's order."""
    rules = F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(_pattern(sequence)).alias("pattern"),
        F.lit("," + "".join(f"${n}," for n in range(1, len(sequence)))).alias("rest")) for name, sequence in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(","))), ""),
                              F.lit(",")).alias("left"),
                     F.array().cast("array<string>").alias("found"))
    done = F.aggregate(rules, start, lambda state, rule: F.when(
        F.regexp_like(state["left"], rule["pattern"]),
        F.struct(F.regexp_replace(state["left"], rule["pattern"], rule["rest"]).alias("left"),
                 F.concat(state["found"], F.array(rule["name"])).alias("found"))).otherwise(state))
    return F.array_distinct(done["found"])


def scan(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, licenses and sentence_ids (comma-joined, the
    licences by rule, the identifiers in the document's order), n_sentences."""
    keyed = docs.select("doc_id", "text").withColumns({
        "__k1": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "__k2": F.xxhash64(F.isnull("doc_id"), "text")})
    found = sentences(keyed).join(F.broadcast(known_sentences(docs.sparkSession)), "sentence")
    by_doc = found.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("place", "id")).alias("found"))
    # a line that is also its whole sentence was found twice at most, at other places
    ids = F.transform(F.sort_array("found"), lambda x: x["id"])
    by_doc = by_doc.select("__k1", "__k2", ids.alias("ids")).select(
        "__k1", "__k2", "ids", F.array_join(match_rules(F.col("ids")), ",").alias("licenses"))
    return keyed.drop("text").join(by_doc, ["__k1", "__k2"], "left").select(
        "doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_sentences"))
