"""Licence scans by sentence rules: normalised sentences have identifiers, and ordered rules read their sequence.

One projection of built-in functions; a text without a licence word is not cut into sentences at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import whole

#: Known sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "Apache2",
    "licensed under the apache license version 2 0 the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies": "MITnotice",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSDgrant",
    "redistributions of source code must retain the above copyright notice": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse": "BSDendorse",
    "licensed under the bsd license": "BSDname",
    "this work is licensed under the gnu general public license version 3": "GPL3",
    "this work is licensed under the gnu general public license version 2": "GPL2",
    "this program is free software": "GPLfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "GPLterms",
    "either version 3 of the license or at your option any later version": "GPL3later",
    "either version 2 of the license or at your option any later version": "GPL2later",
    "licensed under the gnu lesser general public license": "LGPL",
    "licensed under the mozilla public license version 2 0": "MPL2",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "licensed under cc by 4 0": "CCBY4",
    "this work is in the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}
#: Rules in order; the first whose expression is found in the sequence of identifiers names the licence.
RULES = (
    ("Apache-2.0", ",Apache2,(?:ApacheCompliance,)?(?:ApacheCopy,)?(?:ApacheAsIs,)?"),
    ("Apache-2.0", ",ApacheCompliance,(?:[A-Za-z0-9]+,)*ApacheAsIs,"),
    ("BSD-3-Clause", ",BSDgrant,(?:[A-Za-z0-9]+,)*BSDsource,BSDbinary,BSDendorse,"),
    ("BSD-2-Clause", ",BSDgrant,(?:[A-Za-z0-9]+,)*BSDsource,BSDbinary,"),
    ("BSD", ",BSDname,"),
    ("MIT", ",MITname,|,MITgrant,(?:MITnotice,)?"),
    ("GPL-3.0-or-later", ",GPLterms,(?:[A-Za-z0-9]+,)*GPL3later,"),
    ("GPL-2.0-or-later", ",GPLterms,(?:[A-Za-z0-9]+,)*GPL2later,"),
    ("GPL-3.0", ",GPL3,"),
    ("GPL-2.0", ",GPL2,"),
    ("LGPL", ",LGPL,"),
    ("MPL-2.0", ",MPL2,"),
    ("CC-BY-NC-4.0", ",CCBYNC4,"),
    ("CC-BY-SA-4.0", ",CCBYSA4,"),
    ("CC-BY-4.0", ",CCBY4,"),
    ("public-domain", ",PublicDomain,"),
    ("proprietary", ",AllRights,"),
)
#: Every known sentence has one of these; ends of sentences; what a normalised sentence has one blank for.
WORDS = "(?i)licen[sc]e|permi|redistribut|rights|free software|version|notice|copyright|endorse|public domain|compliance|applicable"
ENDS = r"\n|[.;:!?][\x20\x09-\x0D]"
OTHER = "[^a-z0-9]+"


def _sentences(text: Column) -> Column:
    plain = F.transform(F.split(F.lower(text), ENDS), lambda s: F.trim(F.regexp_replace(s, OTHER, " ")))
    return F.filter(plain, lambda s: s.isin(*SENTENCES))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_sentences` known, `sentence_ids` in order, joined by commas, and `license`.

    `license` is the first rule that holds, null if none does, so also for null and empty texts. Repeated rows stay, other
    columns are ignored, an empty table gives an empty one.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    rows = whole(docs, id_col, text_col)
    found = F.when(F.col("text").rlike(WORDS), F.transform(_sentences(F.col("text")), lambda s: F.element_at(known, s)))
    rows = rows.select("id", F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    rows = rows.select("id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    sequence = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    verdict = F.coalesce(*[F.when(sequence.rlike(rule), F.lit(name)) for name, rule in RULES])
    return rows.select(F.col("id").alias(id_col), "n_sentences", "sentence_ids", verdict.alias("license"))
