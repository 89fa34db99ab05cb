"""Queries on labels, identifiers and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from signflow.functions import text as T
from signflow.functions.storage import store
from signflow.operators import gates as G
from signflow.operators.reconcile import classify, sure
from signflow.sources import derived as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _part(s, d):
    return D.table(s, d, "part")


@query("slugify", "select p_partkey, regexp_replace(regexp_replace(lower(' ' || p_name || '/' || p_brand || '.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def slugify(s, d):
    return _part(s, d).select("p_partkey", T.slugify(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit("."))).alias("slug"))


PLAIN = "trim(regexp_replace(lower(replace(x, '_', ' ')), '[^a-z0-9]+', ' ', 'g'))"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
#: Variants of labels and what they stand for.
SYNONYMS = {"the hot gear of a brand 3": "warm gear of brand 3", "cold anvil": "cool anvil"}
FOLD = " ".join(f"when '{k}' then '{v}'" for k, v in SYNONYMS.items())


@query("normalize_label", f"""select p_partkey, array_to_string(list_sort(list_filter(string_split(case y {FOLD} else y end, ' '), lambda w: w <> '' and w not in ({_IN(T.STOPWORDS)}))), ' ') as label
from (select p_partkey, {PLAIN} as y from (select p_partkey, 'The_' || p_name || ' of a ' || p_brand as x from part))""")
def normalize_label(s, d):
    return _part(s, d).select("p_partkey", T.normalise_label(F.concat(F.lit("The_"), "p_name", F.lit(" of a "), "p_brand"), SYNONYMS).alias("label"))


@query("direction_regex", f"""with t as (select p_partkey, case p_size % 9 when 0 then 'Hyper' when 1 then 'hypo' else '' end || p_name || case when p_size > 40 then ' elevated' when p_size > 30 then ' Low' when p_size > 25 then ' depleted excess' else '' end as x from part),
u as (select *, regexp_matches(x, '{T.INCREASE}') as up, regexp_matches(x, '{T.DECREASE}') as down from t)
select p_partkey, case when up and not down then '+' when down and not up then '-' end as sign from u""")
def direction_regex(s, d):
    k = F.col("p_size") % 9
    x = F.concat(F.when(k == 0, "Hyper").when(k == 1, "hypo").otherwise(""), "p_name", F.when(F.col("p_size") > 40, " elevated").when(F.col("p_size") > 30, " Low").when(F.col("p_size") > 25, " depleted excess").otherwise(""))
    return _part(s, d).select("p_partkey", T.direction(x).alias("sign"))


#: Names of terms as annotations have them.
TERM = "case p_size % 4 when 0 then 'Increased circulating ' || p_name || ' level' when 1 then 'Hyper' || (['kalemia', 'glycemia', 'lipidemia'])[p_partkey % 3 + 1] when 2 then 'Reduced blood pressure of x ' || p_name else 'Abnormal cell count' end"


def _term():
    k, root = F.col("p_size") % 4, F.element_at(F.array(*[F.lit(x) for x in ("kalemia", "glycemia", "lipidemia")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return F.when(k == 0, F.concat(F.lit("Increased circulating "), "p_name", F.lit(" level"))).when(k == 1, F.concat(F.lit("Hyper"), root)).when(k == 2, F.concat(F.lit("Reduced blood pressure of x "), "p_name")).otherwise("Abnormal cell count")


ROOTED = "case regexp_replace(w, '^(hyper|hypo)', '') " + " ".join(f"when '{k}' then '{v}'" for k, v in T.ROOTS.items()) + " else w end"


@query("analyte_tokens", f"""with t as (select p_partkey, list_filter(list_distinct(regexp_extract_all(lower({TERM}), '[a-z0-9]+')), lambda w: w not in ({_IN(T.QUALIFIERS)}) and length(w) > 2) as words from part),
u as (select p_partkey, list_sort(list_distinct(list_transform(words, lambda w: {ROOTED}))) as words from t)
select p_partkey, array_to_string(words, ',') as tokens, len(list_filter(words, lambda w: w not in ({_IN(T.GENERIC)}))) > 0 as specific from u""")
def analyte_tokens(s, d):
    words = T.analyte_tokens(_term())
    return _part(s, d).select("p_partkey", F.array_join(words, ",").alias("tokens"), T.has_specific(words).alias("specific"))


CONTAIN = "regexp_extract_all(lower(x), '[a-z0-9]+')"


@query("token_containment_join", f"""with l as (select p_name as l_id, list_distinct({CONTAIN}) as t from (select distinct p_name, p_name as x from part)),
r as (select r_id, list_distinct({CONTAIN}) as t from (select distinct p_name || '/' || p_type as r_id, p_name || ' ' || p_type as x from part)) select l_id, r_id from l join r on list_has_all(r.t, l.t)""")
def token_containment_join(s, d):
    left = _part(s, d).select(F.col("p_name").alias("l_id")).distinct().withColumn("tokens", T.tokens(F.col("l_id")))
    right = _part(s, d).select(F.concat_ws("/", "p_name", "p_type").alias("r_id"), T.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens")).distinct()
    return G.containment_join(left, right)


@query("pmid_extract", r"select p_partkey, list_transform(regexp_extract_all('PMID: ' || p_partkey || '; see PMID:' || p_size, 'PMID:\s*(\d+)', 1), lambda v: v::bigint)[2] as second, len(regexp_extract_all('PMID: ' || p_partkey || '; see PMID:' || p_size, 'PMID:\s*(\d+)', 1))::int as n from part")
def pmid_extract(s, d):
    ids = T.numbers_after(F.concat(F.lit("PMID: "), F.col("p_partkey").cast("string"), F.lit("; see PMID:"), F.col("p_size").cast("string")), "PMID")
    return _part(s, d).select("p_partkey", F.element_at(ids, 2).alias("second"), F.size(ids).alias("n"))


@query("stable_id", "select p_partkey, substr(sha256(p_partkey || chr(31) || p_name || chr(31) || p_brand), 1, 20) as id from part")
def stable_id(s, d):
    return _part(s, d).select("p_partkey", T.stable_id(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")).alias("id"))


@query("ranked_search", """with n as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as a, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as b from part)
select p_partkey, (case when a = 'red ring' or b = 'red ring' then 100 when starts_with(a, 'red ring') or starts_with(b, 'red ring') then 80 when a in ('hot ring', 'ring') then 78 when contains(a, 'red ring') or contains(b, 'red ring') then 60 when contains(a, 'hot ring') or contains(a, 'ring') then 55 else 0 end)::int as score from n""")
def ranked_search(s, d):
    return _part(s, d).select("p_partkey", T.search_score(F.col("p_name"), F.col("p_brand"), "Red_Ring", ("hot ring", "Ring")).alias("score"))


@query("facet_search", "select p_partkey, (case when starts_with(lower(p_type || ':' || p_size), 'small:1') or starts_with(lower(p_brand), 'small:1') then 50 else 0 end)::int as score from part")
def facet_search(s, d):
    return _part(s, d).select("p_partkey", T.facet_score(F.concat("p_type", F.lit(":"), F.col("p_size").cast("string")), F.col("p_brand"), "SMALL:1").alias("score"))


@query("ontology_lookup", "select id, label from (select p_partkey::varchar as id, min(p_name) as label from part group by p_partkey) where contains(lower(label), '10') or contains(lower(id), '10') order by not starts_with(id, '10'), lower(label), id limit 20")
def ontology_lookup(s, d):
    """The first twenty terms that hold what was typed; twenty is how many a lookup shows."""
    return T.lookup(_part(s, d).groupBy(F.col("p_partkey").cast("string").alias("id")).agg(F.min("p_name").alias("label")), "10")


@query("canonical_json", """select p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' as json from part""")
def canonical_json(s, d):
    return _part(s, d).select("p_partkey", T.canonical_json("p_size", "p_name", "p_brand").alias("json"))


@query("percent_encode", "select p_partkey, url_encode(p_name || ' a~b*c/d' || p_brand) as code from part")
def percent_encode(s, d):
    return _part(s, d).select("p_partkey", T.percent_encode(F.concat("p_name", F.lit(" a~b*c/d"), "p_brand")).alias("code"))


@query("version_bump", "select p_partkey, p_size || '.' || (p_size % 7 + 1) || '.0' as minor, p_size || '.' || (p_size % 7) || '.' || (p_partkey + 1) as patch from part")
def version_bump(s, d):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string"), F.col("p_partkey").cast("string"))
    return _part(s, d).select("p_partkey", T.bump(v, "minor").alias("minor"), T.bump(v, "patch").alias("patch"))


@query("submission_id", "select p_partkey, '20260101-' || regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || ' of a very long title'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') as id from part")
def submission_id(s, d):
    return _part(s, d).select("p_partkey", T.submission_id(F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" of a very long title")), F.lit("20260101")).alias("id"))


@query("record_codec", "select doc_id, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') as code, text as back from documents")
def record_codec(s, d):
    """Each text as an unpadded URL-safe record, and what decoding it gives."""
    out = D.table(s, d, "documents").select("doc_id", T.to_base64url(F.encode("text", "UTF-8")).alias("code"))
    return out.withColumn("back", F.decode(T.from_base64url(F.col("code")), "UTF-8"))


@query("version_tuple", "select s_suppkey, string_split(s_acctbal::decimal(12, 2)::varchar, '.')[1]::int as major, string_split(s_acctbal::decimal(12, 2)::varchar, '.')[2]::int as minor from supplier")
def version_tuple(s, d):
    v = T.version_tuple(F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    return D.table(s, d, "supplier").select("s_suppkey", v[0].alias("major"), v[1].alias("minor"))


@query("curie", "select p_partkey, 'PART' as prefix, 'http://purl.example.org/PART_' || p_partkey as iri from part")
def curie(s, d):
    c = F.concat(F.lit("PART:"), F.col("p_partkey").cast("string"))
    return _part(s, d).select("p_partkey", T.curie_prefix(c).alias("prefix"), T.curie_to_iri(c, "http://purl.example.org/").alias("iri"))


@query("column_index", "select c_custkey, ((ascii(substr(c_mktsegment, 1, 1)) - 64) * 26 + ascii(substr(c_mktsegment, 2, 1)) - 65)::int as idx from customer")
def column_index(s, d):
    return D.table(s, d, "customer").select("c_custkey", T.column_index(F.concat(F.substring("c_mktsegment", 1, 2), F.lit("7"))).alias("idx"))


@query("escape_literal", r"""select doc_id, md5(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) as digest from documents""")
def escape_literal(s, d):
    return D.table(s, d, "documents").select("doc_id", F.md5(T.escape_literal(F.col("text"))).alias("digest"))


@query("sign_of", "select s_suppkey, case when abs(s_acctbal) <= 100 then '0' when s_acctbal > 0 then '+' else '-' end as sign from supplier")
def sign_of(s, d):
    return D.table(s, d, "supplier").select("s_suppkey", T.sign_of(F.col("s_acctbal"), 100.0).alias("sign"))


@query("mean_pressure", "select event_id, round(value + (value * 1.5 - value) / 3, 9) as map from events")
def mean_pressure(s, d):
    return D.table(s, d, "events").select("event_id", F.round(T.mean_pressure(F.col("value") * 1.5, F.col("value")), 9).alias("map"))


@query("chapter_slices", """with p as (select doc_id, string_split(text, chr(10)) as pages from documents), q as (select doc_id, unnest(range(1, len(pages) + 1)) as page, unnest(pages) as line from p),
o as (select doc_id, substr(line, 1, 1) as chapter, min(page) as start from q where line <> '' group by doc_id, substr(line, 1, 1)),
x as (select *, lead(start) over (partition by doc_id order by start, chapter) as nxt, (select len(pages) from p where p.doc_id = o.doc_id) as n from o)
select doc_id, chapter, start::int as start, (coalesce(nxt, n + 1) - 1)::int as stop from x""")
def chapter_slices(s, d):
    """Line ranges by first letter: a chapter starts at its first opening and ends before the next one starts."""
    from signflow.sources.scans import slice_chapters

    docs = D.table(s, d, "documents").select(F.col("doc_id"), "text")
    return slice_chapters(docs, "doc_id", "text", "\n", F.substring("line", 1, 1))


#: Proposed nodes: known ones, turned labels, other qualities, like labels and new ones.
PROPOSED = """p as (select case when p_size < 8 then p_partkey else p_partkey + 1000000 end as id,
  case when p_size < 20 then regexp_replace(p_name, '^(\\w+) (\\w+)$', '\\2_\\1') || ' ' || p_brand when p_size < 30 then p_name || 'z ' || p_brand else 'quite another ' || p_partkey end as label,
  p_type as entity_iri, case when p_size % 2 = 0 then p_brand else 'Q' end as quality_iri from part),
c as (select p_partkey as match, p_name || ' ' || p_brand as label, p_type || '!' as ce, p_brand as cq from part)"""


def _proposed(s, d):
    part = _part(s, d)
    catalog = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("label"), F.concat("p_type", F.lit("!")).alias("entity_iri"), F.col("p_brand").alias("quality_iri"))
    label = F.when(F.col("p_size") < 20, F.concat(F.regexp_replace("p_name", r"^(\w+) (\w+)$", "$2_$1"), F.lit(" "), "p_brand")).when(F.col("p_size") < 30, F.concat("p_name", F.lit("z "), "p_brand")).otherwise(F.concat(F.lit("quite another "), F.col("p_partkey").cast("string")))
    ident = F.when(F.col("p_size") < 8, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1000000)
    proposed = part.select(ident.alias("id"), label.alias("label"), F.col("p_type").alias("entity_iri"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("Q").alias("quality_iri"))
    return proposed, catalog


NORM = f"array_to_string(list_sort(list_filter(string_split({PLAIN.replace('(x,', '(label,')}, ' '), lambda w: w <> '' and w not in ({_IN(T.STOPWORDS)}))), ' ')"


@query("reconcile_sure", f"""with {PROPOSED}, pn as (select *, {NORM} as norm from p), cn as (select *, {NORM} as norm from c),
known as (select id from p where id in (select match from c)), hit as (select pn.id, cn.match, case when pn.quality_iri <> cn.cq then 0.84 else 0.95 end as score from pn join cn using (norm) where id not in (select id from known))
select id, 'existing' as status, id as match, 1.0::double as score from known union all
select id, case when max(score) >= 0.9 then 'duplicate' else 'review' end, arg_min(match, (-score, match)), max(score)::double from hit group by id""")
def reconcile_sure(s, d):
    """Known ids and equal labels."""
    return sure(*_proposed(s, d))


@query("reconcile")
def reconcile(s, d):
    """All layers, like labels among them."""
    return store(classify(*_proposed(s, d)), "reconciled")
