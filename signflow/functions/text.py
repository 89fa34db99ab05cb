"""Scalar functions on labels, identifiers and codes, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a label comparison ignores.
STOPWORDS = ("the", "a", "an", "of", "in", "level", "levels", "concentration", "amount")
#: Words and beginnings that tell a direction, as patterns.
INCREASE = r"(?i)\b(increased|elevated|high|excess|excessive|raised)\b|^hyper"
DECREASE = r"(?i)\b(decreased|reduced|low|deficiency|deficient|depleted|loss|reduction)\b|^hypo"
#: Words of a term's name that don't name what is measured.
QUALIFIERS = tuple("abnormal abnormality abnormally circulating serum plasma blood concentration level levels of the in increased decreased elevated reduced high low excess excessive raised deficiency deficient depleted content amount total a an".split())
#: Words too general to name an analyte by themselves.
GENERIC = tuple("pressure protein hormone acid cell volume rate output vitamin factor count index mass function activity response system ratio concentration enzyme globulin compound metabolite".split())
#: Clinical roots and the analytes they stand for.
ROOTS = {
    "kalemia": "potassium", "kalaemia": "potassium", "natremia": "sodium", "natraemia": "sodium", "calcemia": "calcium", "calcaemia": "calcium",
    "phosphatemia": "phosphate", "phosphataemia": "phosphate", "glycemia": "glucose", "glycaemia": "glucose", "uricemia": "urate", "uricaemia": "urate",
    "magnesemia": "magnesium", "magnesaemia": "magnesium", "cholesterolemia": "cholesterol", "triglyceridemia": "triglyceride", "ammonemia": "ammonia",
    "ammonaemia": "ammonia", "lipidemia": "lipid", "proteinemia": "protein", "insulinemia": "insulin", "phenylalaninemia": "phenylalanine",
    "methioninemia": "methionine", "bilirubinemia": "bilirubin", "magnesiumemia": "magnesium",
}


def slugify(x: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def submission_id(title: Column, stamp: Column) -> Column:
    """A name that is safe in a path: the time and at most forty characters of the title's slug."""
    return F.concat_ws("-", stamp, F.regexp_replace(F.substring(F.coalesce(F.nullif(slugify(title), F.lit("")), F.lit("contribution")), 1, 40), "-+$", ""))


def is_safe_id(x: Column) -> Column:
    return x.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(x, F.lit(".."))


def plain_label(x: Column) -> Column:
    """Lower case, underscores and punctuation as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "_", " ")), "[^a-z0-9]+", " "))


def normalise_label(x: Column, synonyms: dict[str, str] | None = None, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The form in which labels are compared: a whole phrase that is a known variant becomes its canonical one, stopwords go, words are sorted.

    ``synonyms`` has plain variants and plain canonical phrases.
    """
    base = plain_label(x)
    if synonyms:
        table = F.create_map(*[F.lit(w) for pair in sorted(synonyms.items()) for w in pair])
        base = F.coalesce(table[base], base)
    return F.array_join(F.array_sort(F.filter(F.split(base, " "), lambda w: (w != "") & ~w.isin(*stopwords))), " ")


def direction(x: Column) -> Column:
    """+ for words of increase, - for words of decrease, null for neither or both."""
    up, down = x.rlike(INCREASE), x.rlike(DECREASE)
    return F.when(up & ~down, "+").when(down & ~up, "-")


def tokens(x: Column) -> Column:
    """Distinct lower-case words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))))


def analyte_tokens(x: Column) -> Column:
    """Words that name what a term measures: no qualifiers, none of one or two characters, clinical roots as their analyte; sorted."""
    roots = F.create_map(*[F.lit(w) for pair in sorted(ROOTS.items()) for w in pair])
    kept = F.filter(tokens(x), lambda t: ~t.isin(*QUALIFIERS) & (F.length(t) > 2))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.coalesce(roots[F.regexp_replace(t, "^(hyper|hypo)", "")], t))))


def has_specific(words: Column) -> Column:
    """Whether some word is more than general."""
    return F.exists(words, lambda t: ~t.isin(*GENERIC))


def numbers_after(x: Column, prefix: str) -> Column:
    """All numbers that follow a prefix and a colon, such as citations, as longs."""
    return F.transform(F.regexp_extract_all(x, F.lit(rf"{prefix}:\s*(\d+)"), F.lit(1)), lambda v: v.cast("long"))


def stable_id(*parts: Column) -> Column:
    """Twenty hex digits of the SHA-256 of the parts, joined by a unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 20)


def to_base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x), "+/\n\r", "-_"), F.lit("="))


def from_base64url(x: Column) -> Column:
    return F.unbase64(F.translate(x, "-_", "+/"))


def search_score(label: Column, ident: Column, term: str, variants: tuple[str, ...] = ()) -> Column:
    """How well a node's label or id answers a search, 0 for not at all.

    100 equal, 80 at the start, 78 equal to a variant of the term, 60 inside, 55
    a variant inside the label; on plain lower-case words.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    a, b, q = plain(label), plain(ident), plain(F.lit(term))
    v = [plain(F.lit(x)) for x in variants]
    none = F.lit(False)
    same = reduce(lambda x, y: x | (a == y), v, none)
    inside = reduce(lambda x, y: x | (F.contains(a, y) & (F.length(y) >= 3)), v, none)
    long = F.length(q) >= 2
    return F.when((a == q) | (b == q), 100).when(F.startswith(a, q) | F.startswith(b, q), 80).when(same, 78).when(long & (F.contains(a, q) | F.contains(b, q)), 60).when(inside, 55).otherwise(0)


def facet_score(entity: Column, quality: Column, prefix: str) -> Column:
    """50 for nodes whose entity or quality identifier begins with what was typed, such as a prefix and a colon."""
    p = F.lit(prefix.lower())
    return F.when(F.startswith(F.lower(F.coalesce(entity, F.lit(""))), p) | F.startswith(F.lower(F.coalesce(quality, F.lit(""))), p), 50).otherwise(0)


def lookup(terms: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first terms (id, label) that hold the query: those whose id begins with it first, then by label and id."""
    q = F.lit(query.casefold())
    hit = F.contains(F.lower("label"), q) | F.contains(F.lower("id"), q)
    return terms.where(hit).withColumn("first", F.startswith(F.lower("id"), q)).orderBy(F.desc("first"), F.lower("label"), "id").limit(limit).drop("first")


def version_tuple(x: Column) -> Column:
    """The numbers of a dotted version; arrays of them compare as versions do."""
    return F.transform(F.split(x, r"\."), lambda v: v.cast("int"))


def bump(x: Column, part: str) -> Column:
    """The next version: ``major``, ``minor`` or ``patch`` raised, what follows it zero."""
    v = version_tuple(x)
    at = {"major": 0, "minor": 1, "patch": 2}[part]
    return F.concat_ws(".", *[((v[i] + 1) if i == at else v[i] if i < at else F.lit(0)).cast("string") for i in range(3)])


def canonical_json(*columns: str) -> Column:
    """A row's columns as JSON, keys in order, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def percent_encode(x: Column) -> Column:
    """A string as it stands in a path of an IRI: a space is %20, ~ stays."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def curie_prefix(x: Column) -> Column:
    return F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9_.-]*):\S+$", 1)


def curie_to_iri(x: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(x, ":", "_"))


def column_index(ref: Column) -> Column:
    """The number, from 0, of a spreadsheet column's letters."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def escape_literal(x: Column) -> Column:
    """A string as it stands between the quotes of a Turtle or OWL literal."""
    out = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sign_of(x: Column, tolerance: float = 1e-9) -> Column:
    return F.when(F.abs(x) <= tolerance, "0").when(x > 0, "+").otherwise("-")


def mean_pressure(systolic: Column, diastolic: Column) -> Column:
    return diastolic + (systolic - diastolic) / 3


def harmonic_chance(n: Column) -> Column:
    """The mean reciprocal rank of a random guess among n."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, k: acc + 1.0 / k) / n
