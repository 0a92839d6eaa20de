"""Licence scans: digests of normalised texts, looked up among the digests of known licences.

A text is put into a canonical form (lower case, no copyright notices, every run of other characters
than letters and digits one separator, one spelling for equivalent spellings) and hashed.  A copyright
line is one that starts with ``copyright`` or ``(c)`` and a year, or with a name after the sign; other lines that start with
those words are the licence's own, so that a text's digest doesn't depend on where its lines break.  Two units
are looked up with one hash join: the whole text, and each whole line of it, as notices of one line
stand within other text.  DataFrame functions only.

The query's list holds entire texts of 18 licences (the folder ``licenses``, MIT and ISC), each in the
spellings in which it is commonly spread, and one-line notices.

Scale: one pass over the text; a line's form is made once, and a text's form is joined of its lines'.  Known digests are counted: up to
``BROADCAST_KNOWN`` they are broadcast, so that lines that match none never leave their task; more are joined by shuffle.

Edge cases: null and empty texts, and texts that are nothing but copyright lines and punctuation,
have the digest of the empty form and match nothing.  Equal texts get equal rows; rows with equal
ids are reported one by one, as each is numbered first.  Two known licences with one digest both
match: the smallest id is given for the whole text, all of them among the notices.  Empty tables
give empty results; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import table

#: Spellings that count as one, as published matching guidelines for licences list them: (from, to).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("noncommercial", "non  commercial"), ("sublicence", "sublicense"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
#: What stands before what is printed after the terms of a licence, which many copies leave out.
AFTER_TERMS = re.compile(r"(?m)^[ \t]*(?:END OF TERMS AND CONDITIONS\s*)?(?:(?:APPENDIX|ADDENDUM): How to (?:apply|use)|How to Apply These Terms to Your New).*$", re.IGNORECASE)
FRANKLIN = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301\s+USA")
TEMPLE = "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"
BSD_TITLES = {"0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}


def _spellings(name: str, text: str) -> list[str]:
    """A licence's entire text as it is commonly spread: with or without what follows the terms, older addresses, BSD's heads and list marks."""
    out = [text]
    if end := AFTER_TERMS.search(text):
        terms = text[: end.start()]
        out += [terms, f"{terms}\nEND OF TERMS AND CONDITIONS\n"]
    out += [FRANKLIN.sub(TEMPLE, t) for t in out] + [t.replace("https://", "http://") for t in out]
    if name in BSD_TITLES:
        out = [t.replace("COPYRIGHT\nHOLDER OR", who).replace("COPYRIGHT HOLDER OR", who) for t in out for who in ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")]
        out += [re.sub(r"(?m)^[ \t]*[123]\.", "*", t) for t in out]
        bare = [t.replace("All rights reserved.\n", "", 1) for t in out]
        reserved = [f"All rights reserved.\n{t}" for t in bare]
        out = [head + t for t in bare + reserved for head in ("", f"{BSD_TITLES[name]}\n")]
    return list(dict.fromkeys(out))


def _entire() -> tuple[tuple[str, str], ...]:
    """(id, text) of the texts in the folder ``licenses``; a file is named by its licence's id, and what parts it from others of that id."""
    found = sorted((f.name, f.read_text()) for f in files("echofold.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt"))
    ids = [(name.removesuffix(".txt").removesuffix(".regents"), text) for name, text in found]
    return tuple((name, t) for name, text in ids for t in _spellings(name, text))


#: (id, text) of the query's known licences: entire texts, and notices of one line.
KNOWN = (
    *_entire(),
    ("MIT", MIT), ("MIT", f"MIT License\n{MIT}"), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC), ("ISC", f"ISC License\n{ISC}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ARR", "All rights reserved."),
)


#: Notices inside licences themselves, wherever their lines break: those of the licence's own text, and places to fill in.
OWN_NOTICE = (
    r"copyright[ \t\r\n]+(?:\(c\)[ \t\r\n]+)?"
    r"(?:[0-9, \t\r\n]+free[ \t\r\n]+software[ \t\r\n]+foundation,[ \t\r\n]+inc\.?"
    r"|(?:<year>|19yy|year|\[yyyy\])[ \t\r\n]+(?:<name[ \t\r\n]+of[ \t\r\n]+author>|your[ \t\r\n]+name|\[name[ \t\r\n]+of[ \t\r\n]+copyright[ \t\r\n]+owner\]))"
)
#: The rest of a copyright line, after what may stand before it: a name after the sign, or a year.
NOTICE = r"[ \t]*(?:[*#/;%-]+[ \t]*)?(?:©.*|\(c\)[ \t]*(?:19|20)[0-9][0-9].*|copyright[ \t:]*(?:\(c\)|©).*|copyright[ \t:]+(?:by[ \t]+)?(?:19|20)[0-9][0-9].*)"
#: Known digests that are broadcast at most, 100 bytes each; more are joined by shuffle.
BROADCAST_KNOWN = 100_000


def _one_of(words: Sequence[str]) -> str:
    """A pattern of the words between spaces, grouped by their first letters."""
    letters = sorted({w[0] for w in words})
    return " (?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in letters) + ") "


def line_forms(text: Column) -> Column:
    """The canonical form of each line: words parted by two spaces, without copyright notices and in one spelling."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(low, OWN_NOTICE, " "), f"(?md)^{NOTICE}$", "")
    kept = F.when(F.rlike(low, F.lit(r"copyright|\(c\)|©")), bare).otherwise(low)
    words = F.replace(F.regexp_replace(kept, r"[^a-z0-9\n\p{L}\p{N}]+", "  "), F.lit("\n"), F.lit(" \n "))
    return F.transform(F.split(_spelled(F.concat(F.lit(" "), words, F.lit(" "))), "\n"), lambda x: F.trim(x))


def _spelled(words: Column) -> Column:
    out = words
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(F.rlike(words, F.lit(_one_of([a for a, _ in SPELLINGS]))), out).otherwise(words)


def whole_form(lines: Column) -> Column:
    """The canonical form of a text, wherever its lines break, of its lines' forms."""
    return F.array_join(F.filter(lines, lambda x: x != ""), "  ")


def digest(form: Column) -> Column:
    return F.sha2(F.concat(F.lit(" "), form, F.lit(" ")).cast("binary"), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license_id) of (id, text) pairs; forms without a word are left out."""
    df = spark.createDataFrame(list(known), "license_id string, license_text string").select("license_id", whole_form(line_forms(F.col("license_text"))).alias("form"))
    return df.filter("form <> ''").select(digest(F.col("form")).alias("digest"), "license_id").distinct()


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_digest, license_id (of the whole text, or null), notices (sorted ids of whole lines, comma-joined).

    ``known``: digest, license_id, as ``known_digests`` gives them.
    """
    forms = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("__row"), line_forms(F.col(text_col)).alias("__lines"))
    units = F.concat(F.array(whole_form(F.col("__lines"))), F.filter("__lines", lambda x: x != ""))
    hashed = forms.select(id_col, "__row", F.posexplode(units).alias("__unit", "__form")).select(id_col, "__row", (F.col("__unit") == 0).alias("__whole"), digest(F.col("__form")).alias("digest"))
    few = known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN
    found = hashed.join(F.broadcast(known) if few else known, "digest", "left").filter("__whole or license_id is not null")
    return (
        found.groupBy(id_col, "__row")
        .agg(
            F.max(F.when(F.col("__whole"), F.col("digest"))).alias("text_digest"),
            F.min(F.when(F.col("__whole"), F.col("license_id"))).alias("license_id"),
            F.array_join(F.sort_array(F.collect_set(F.when(~F.col("__whole"), F.col("license_id")))), ",").alias("notices"),
        )
        .drop("__row")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"), known_digests(spark))


def _oracle() -> str:
    """The same digests from another order of steps: lines are parted first, spellings are replaced in each."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "regexp_replace(regexp_replace(lower({}), " + quote(OWN_NOTICE) + ", ' ', 'g'), " + quote("(?m)^" + NOTICE + "$") + ", '', 'g')"
    spelled = "x"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, ' {a} ', ' {b} ')"
    form = f"(SELECT string_agg(trim({spelled}), '  ' ORDER BY i) FILTER (trim(x) <> '') FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i))"
    lines = "list_transform(string_split({}, chr(10)), lambda y: ' ' || trim(regexp_replace(y, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' ')"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT DISTINCT license_id, sha256(' ' || f || ' ') AS digest
  FROM (SELECT license_id, {form} AS f FROM (SELECT license_id, {lines.format(plain.format("t"))} AS u FROM (VALUES {values}) v(license_id, t))) WHERE f IS NOT NULL),
parted AS (
  SELECT doc_id, {lines.format(plain.format("coalesce(text, '')"))} AS u FROM documents),
whole AS (
  SELECT doc_id, sha256(' ' || coalesce({form}, '') || ' ') AS text_digest FROM parted),
lines AS (
  SELECT doc_id, sha256(' ' || trim({spelled}) || ' ') AS digest FROM (SELECT doc_id, unnest(u) AS x FROM parted) WHERE trim(x) <> ''),
notices AS (
  SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices FROM lines l JOIN known k USING (digest) GROUP BY l.doc_id)
SELECT w.doc_id, w.text_digest, (SELECT min(license_id) FROM known k WHERE k.digest = w.text_digest) AS license_id,
  coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN notices n USING (doc_id)
"""


ORACLE = _oracle()
