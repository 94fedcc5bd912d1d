"""License scan by canonical digest: whole texts, lines and paragraphs against known texts and notices.

Texts are brought to one form before they are hashed: lower case, copyright lines left out,
punctuation and white space as one space, equivalent spellings as one. The digest of a document's
whole canonical text is looked up among the digests of known licence texts, and so are those of
its single lines and of its paragraphs (lines joined up to a blank or copyright line), for notices
that stand in other text. The table of digests is a fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known notices (fixed values): the short forms that licences ask to be put into a work.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
#: Paragraphs that licences ask to be put into a work, or that grant the rights (fixed values).
_GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
PARAGRAPHS = (
    ("Apache-2.0", _APACHE),
    *(("Apache-2.0", f"{_APACHE} {scheme}://www.apache.org/licenses/LICENSE-2.0") for scheme in ("http", "https")),
    ("GPL-2.0-or-later", _GPL.format(";", "General Public License", ";", 2)),
    ("GPL-3.0-or-later", _GPL.format(":", "General Public License", ",", 3)),
    ("LGPL-3.0-or-later", _GPL.format(":", "Lesser General Public License", ",", 3)),
    ("AGPL-3.0-or-later", _GPL.format(":", "Affero General Public License", ",", 3)),
    *(("MPL-2.0", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/.") for scheme in ("http", "https")),
)
#: Canonical digests of whole licence texts (fixed values): as published and with each paragraph on
#: one line, with and without a title; Apache, GPL and LGPL-2.1 with and without what follows the terms.
TEXTS = (
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "a11471bc40750a21bd4508891b5626642657a09eaa0ef1ec576be7d37fe5ada8"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4"),
    ("ISC", "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "94b4e9f723d13830ec6a47b422738caee264943af1673fa32782cefd730ffc82"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "e00f31f158e77a60e7375307e014eeb17754967f6d6757d019567221315db4e1"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "594673f8fe0542761280c31fa6f0d1eca9f491e533af6c2c1fef40b1c4229b47"),
    ("Apache-2.0", "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad"),
    ("Apache-2.0", "36229a9956938571a99113d590fb0e618aa4a86f7ddbf0874bba96f83a26a8a5"),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),
    ("Apache-2.0", "e80c728dad9283541363fd9f60e4c0527fadc838f92f45f514c14da7f0a481ad"),
    ("GPL-2.0-only", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0-only", "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9"),
    ("GPL-2.0-only", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0-only", "c928252f428993b646c70c671425ec87aab1bc5abf42e7a179685a96469bd918"),
    ("GPL-2.0-only", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0-only", "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5"),
    ("GPL-3.0-only", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("GPL-3.0-only", "39a6efa3076af232de61a13d09b777c9757af7b24bc258ead3c3e02130c0c999"),
    ("GPL-3.0-only", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("GPL-3.0-only", "3129d737330c12f3281f0f8fcd4799ddbc6f254181868ae29d6ca65827f0682b"),
    ("GPL-3.0-only", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0-only", "7300741b7882c4cee1198306545302285397b5dbcfa263d41588b8b85e01aefd"),
    ("LGPL-2.1-only", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-2.1-only", "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f"),
    ("LGPL-2.1-only", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a"),
    ("LGPL-2.1-only", "98ee2ec068a51049ed400919bcc9b031bd9fcb4141726f51e23b5f0196a2d37a"),
    ("LGPL-2.1-only", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1"),
    ("LGPL-2.1-only", "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0-only", "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "958f21dc8dffc8ff8e2cd52fee0a8a694d6cbc45344ba2aa6e9802e632a8fc03"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC-BY-4.0", "5f58202644df85e573368a98c4f6d4bc50c812b7ce5c64377017994e2fe2f4b2"),
    ("CC-BY-4.0", "e0f40daaf586ac276783c90c29c03132487f9d7212d46b48281e588355b421a7"),
)
#: Spellings taken as equal (fixed values).
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("whilst", "while"), ("sub license", "sublicense"), ("non commercial", "noncommercial"))
_COPYRIGHT = r"(?im)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The form that is hashed: see the module's text. Null stays null."""
    return _respelt(F.regexp_replace(F.lower(F.regexp_replace(text, _COPYRIGHT, " ")), r"[^\p{L}\p{N}]+", " "))


def _respelt(plain: Column) -> Column:
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    for spelling, usual in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(padded)


def _digest(text: Column) -> Column:
    return F.when(text != "", F.sha2(text.cast("binary"), 256))


_LONGEST = max(len(n) for _, n in (*NOTICES, *PARAGRAPHS))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of NOTICES, PARAGRAPHS and TEXTS: a few rows, one for each canonical text."""
    rows = spark.createDataFrame([*NOTICES, *PARAGRAPHS], "license string, notice string")
    said = rows.select(_digest(canonical(F.col("notice"))).alias("digest"), "license")
    whole = spark.createDataFrame(TEXTS, "license string, digest string").select("digest", "license")
    return said.union(whole).groupBy("digest").agg(F.min("license").alias("license"))


def _paragraphs(lines: Column) -> Column:
    """Paragraphs of more than one line, from canonical lines of which blank ones end a paragraph."""
    runs = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: F.btrim(x, F.lit("\n")))
    return F.transform(F.filter(runs, lambda x: (F.length(x) <= _LONGEST) & F.contains(x, F.lit("\n"))), lambda x: _respelt(F.replace(x, F.lit("\n"), F.lit(" "))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, digest of the whole canonical text, license (of the whole text), lines.

    ``digest`` is null for null texts and those without a letter or digit; ``license`` is null
    unless the entire text is a known one. ``licenses`` lists the licences of the entire text, of
    single lines or of paragraphs, sorted, comma-joined; ``n_lines`` counts such lines and such
    paragraphs of more than one line. Rows are kept one by
    one, with null or repeated ids too; an empty table gives no rows. Only the fixed list of digests
    is sent to the tasks, so no row is shuffled.
    """
    known = known_digests(docs.sparkSession).agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("known")).scalar()
    text = docs[text_col]
    given = docs.select(docs[id_col].alias("doc_id"), _digest(canonical(text)).alias("digest"), F.transform(F.split(text, "\n"), lambda x: canonical(x)).alias("lines"))
    parts = F.concat(F.filter("lines", lambda x: (F.length(x) <= _LONGEST) & (x != "")), _paragraphs(F.col("lines")))
    named = given.select("doc_id", "digest", parts.alias("parts")).withColumn("known", known).select(
        "doc_id", "digest",
        F.element_at("known", F.col("digest")).alias("license"),
        F.filter(F.transform("parts", lambda x: F.element_at("known", F.sha2(x.cast("binary"), 256))), lambda x: x.isNotNull()).alias("found"),
    )
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.when(F.col("license").isNotNull(), F.array("license")).otherwise(F.array().cast("array<string>")))))
    return named.select(
        "doc_id", "digest", "license", F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n_lines"), F.concat_ws(",", every).alias("licenses")
    )


def _canonical_sql(text: str) -> str:
    plain = rf"regexp_replace(lower(regexp_replace({text}, '(?im)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    out = f"' ' || {plain} || ' '"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {usual} ')"
    return f"trim({out})"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in NOTICES)
ORACLE = f"""
WITH known AS (SELECT sha256({_canonical_sql("notice")}) AS digest, min(license) AS license FROM (VALUES {_VALUES}) n(license, notice) GROUP BY 1),
whole AS (SELECT doc_id, {_canonical_sql("text")} AS c, text, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, {_canonical_sql("line")} AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM whole)),
found AS (SELECT r, license FROM lines JOIN known ON digest = sha256(c) WHERE c <> ''),
named AS (SELECT doc_id, r, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM whole),
every AS (SELECT r, license FROM found UNION SELECT r, license FROM named JOIN known USING (digest))
SELECT doc_id, digest, license, (SELECT count(*) FROM found f WHERE f.r = n.r) AS n_lines,
  coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM every e WHERE e.r = n.r), '') AS licenses
FROM named n LEFT JOIN known USING (digest)
"""
