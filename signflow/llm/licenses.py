"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: lower case, equivalent spellings made
one, copyright lines dropped, punctuation and white space made single spaces.
The digest of the whole canonical text is hash-joined with the digests of known
licence texts; so is the digest of every single line, which finds the short
notices inside documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import table
from signflow.llm.license_texts import LONG_TEXTS, known, openings

#: Fixed values: (written form, canonical form) in lower-cased text with its signs, and in single-spaced words.
SIGNS = (("&", " and "), ("http:", "https:"))
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("per cent", "percent"),
)
#: A copyright statement: its mark with a year, a sign or a placeholder, up to the line's end or the opening words of a licence.
COPYRIGHT = r"(?:copyright\s*(?:\(c\)|©|[<\[{]|\d{4})|\(c\)\s*(?:copyright|\d{4}|[<\[])|©|all rights reserved).*?((?:" + "|".join(openings()) + r").*)?$"

#: A line that begins so names a holder without a year, unless one of these words follows, as in licences' own sentences.
HOLDER = r"^copyright [\p{L}\p{N}]"
NO_HOLDER = r"^copyright (?:%s)(?: |$)" % "|".join("also and are by disclaimer doctrines for holder holders if in interest interests is law laws license licenses like line notice notices of on or owner owners ownership patent permission protection resulting rights statement statements that the this those to treaty under".split())

#: Rows of known licences up to which their digests are broadcast.
MAX_BROADCAST_ROWS = 100_000


def canonical_words(line: Column) -> Column:
    """The words of one line, lower-cased and single-spaced, with copyright statements cut out."""
    x = F.lower(line)
    for written, form in SIGNS:
        x = F.replace(x, F.lit(written), F.lit(form))
    words = F.trim(F.regexp_replace(F.regexp_replace(x, COPYRIGHT, "$1"), r"[^\p{L}\p{N}]+", " "))
    return F.when(words.rlike(HOLDER) & ~words.rlike(NO_HOLDER), "").otherwise(words)


def spelt(words: Column) -> Column:
    """Equivalent spellings made one; on words, so that it doesn't matter where a line ended."""
    for written, form in SPELLINGS:
        words = F.replace(words, F.lit(written), F.lit(form))
    return words


def canonical_lines(text: Column) -> Column:
    """The words of a text's lines, but for lines without words; a null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), canonical_words), lambda x: x != "")


def canonical_text(lines: Column) -> Column:
    return spelt(F.array_join(lines, " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """(license_digest, license_id) of (license_id, text[, license_digest]) rows; a given digest counts where there is no text; of equal ones the least id stays, empty texts are left out."""
    whole = canonical_text(canonical_lines(F.col("text")))
    given = F.col("license_digest") if "license_digest" in licenses.columns else F.lit(None).cast("string")
    told = licenses.where("license_id is not null").select("license_id", whole.alias("whole"), given.alias("given"))
    told = told.select("license_id", F.when(F.col("whole") != "", digest(F.col("whole"))).otherwise(F.col("given")).alias("license_digest"))
    return told.where("license_digest is not null").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text, license_digest): texts that are known, and digests of long ones that are known by these alone."""
    rows = [(i, t, None) for i, t in known()] + [(i, None, d) for i, d in LONG_TEXTS]
    return spark.createDataFrame(rows, "license_id string, text string, license_digest string")


def scan_licenses(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, license_id, notices.

    ``license_id`` is the licence whose text the whole document is, else null.
    ``notices`` is the sorted array of licences of which a single line of the
    document is the whole text.  Empty and null texts have the digest of the
    empty text and no licence.  Null ids, shared ids and repeated rows are rows
    of their own; an empty table gives an empty table; other columns are not
    read.  Texts are made canonical once; the digests of the whole and of the
    lines are matched before any shuffle while the known ones are few enough to
    broadcast, beyond that they are joined on the digest.
    """
    known_ones = known_digests(licenses)
    small = licenses.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    known_ones = F.broadcast(known_ones) if small else known_ones
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    parts = F.array_distinct(F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), digest(spelt(x)).alias("digest"))))
    whole = F.array(F.struct(F.lit(True).alias("whole"), digest(canonical_text(F.col("lines"))).alias("digest")))
    rows = d.select("row", "doc_id", F.explode(F.concat(whole, parts)).alias("p")).select("row", "doc_id", "p.whole", "p.digest")
    met = rows.join(known_ones, F.col("digest") == F.col("license_digest"), "left").where("whole or license_id is not null")
    found = met.groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.struct("doc_id", "digest", "license_id"))).alias("all"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("notices"),
    )
    return found.select("all.doc_id", F.col("all.digest").alias("text_digest"), "all.license_id", "notices")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))
    return out.select("doc_id", "text_digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _oracle() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def replaced(x: str, pairs: tuple[tuple[str, str], ...]) -> str:
        for written, form in pairs:
            x = f"replace({x}, {quoted(written)}, {quoted(form)})"
        return x

    plain = f"trim(regexp_replace(regexp_replace({replaced('lower(x)', SIGNS)}, {quoted(COPYRIGHT)}, '\\1'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    words = f"(case when regexp_matches({plain}, {quoted(HOLDER)}) and not regexp_matches({plain}, {quoted(NO_HOLDER)}) then '' else {plain} end)"
    canon = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: {words}), lambda z: z <> '')"
    whole, one = replaced("array_to_string(lines, ' ')", SPELLINGS), replaced("line", SPELLINGS)
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known())
    long_rows = ", ".join(f"({quoted(d)}, {quoted(i)})" for i, d in LONG_TEXTS)
    return f"""
with l(license_id, text) as (values {rows}),
kl as (select license_id, {canon} as lines from l),
k as (select dg, min(license_id) as license_id from (select sha256({whole}) as dg, license_id from kl where len(lines) > 0 union all select * from (values {long_rows})) group by dg),
d as (select doc_id, {canon} as lines from documents),
n as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices
      from (select doc_id, unnest(lines) as line from d) join k on sha256({one}) = dg group by doc_id)
select d.doc_id, sha256({whole}) as text_digest, k.license_id, coalesce(notices, '') as notices
from d left join k on sha256({whole}) = dg left join n on n.doc_id = d.doc_id
"""


ORACLE = _oracle()
