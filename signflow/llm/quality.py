"""Quality rules with thresholds that adapt to each language and source.

Every metric is summarised by a KLL quantile sketch per (language, source).
Sketches merge, so those of a language are the merged sketches of its sources.
A document is rejected where a metric lies beyond its group's fence: the
quartile plus ``reach`` times the interquartile range, and at least a
tolerance.  Small groups use the language's fence.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Items a sketch keeps exactly before it starts to approximate.
SKETCH_K = 2048
#: Rows below which a group uses its language's fence.
MIN_GROUP = 100
REACH = 3.0
#: A group's fence lies at most this many times as far out as its language's.
STRETCH = 3.0
#: metric: (sides that are fenced, least distance of a fence from its quartile)
METRICS = {
    "mean_word": ("both", 1.0),
    "symbol_ratio": ("high", 0.1),
    "dup_line_ratio": ("high", 0.3),
    "repeat_ratio": ("high", 0.2),
    "upper_ratio": ("high", 0.15),
}

_REPEATED = f"""
case when size(array_distinct(wins)) = size(wins) then 0L else
  transform(array(array_sort(transform(wins, (h, i) -> struct(h as h, i as i)))), s ->
    aggregate(
      array_sort(transform(filter(s, (e, k) -> get(s, k - 1).h <=> e.h or get(s, k + 1).h <=> e.h), e -> e.i)),
      named_struct('n', 0L, 'last', -{WINDOW}),
      (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p),
      a -> a.n))[0]
end
"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts, and the metrics, one row per row of ``docs``.

    A null text counts as empty.  Repeated rows are kept.  Other columns are not read.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ws = " \t\n\x0b\x0c\r"
    df = df.withColumns(
        {
            "words": F.filter(F.split("text", SPACE), lambda x: x != ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.translate(x, ws, "") != ""),
            "word_chars": F.length(F.translate("text", ws, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_upper": F.expr(r"regexp_count(text, '\\p{Lu}')").cast("long"),
        }
    ).drop("text")
    df = df.withColumns(
        {
            "hashes": F.transform("words", lambda x: F.xxhash64(x)),
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("words", "lines")
    df = df.withColumn("wins", F.expr(f"case when size(hashes) < {WINDOW} then array() else transform(sequence(1, size(hashes) - {WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW}))) end")).drop("hashes")
    df = df.withColumn("n_repeat_words", F.expr(_REPEATED).cast("long")).drop("wins")
    words, lines, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "mean_word": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
            "repeat_ratio": F.col("n_repeat_words") / words,
            "upper_ratio": F.col("n_upper") / chars,
        }
    )


def _fences(sketches: DataFrame, keys: list[str], tag: str) -> DataFrame:
    out = [*keys, F.col("n").alias(f"{tag}_n")]
    for m, (side, least) in METRICS.items():
        q1, q3 = (F.expr(f"kll_sketch_get_quantile_double(s_{m}, {r}D)") for r in (0.25, 0.75))
        gap = F.greatest(REACH * (q3 - q1), F.lit(least))
        out.append((q3 + gap).alias(f"{tag}_{m}_hi"))
        if side == "both":
            out.append((q1 - gap).alias(f"{tag}_{m}_lo"))
    return sketches.select(*out)


def thresholds(measured: DataFrame, k: int = SKETCH_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fences per (lang, source), per lang, and over all, from the rows that pass the base rules.

    Null languages and sources are groups like any other.
    """
    agg = [F.expr(f"kll_sketch_agg_double({m}, {k})").alias(f"s_{m}") for m in METRICS]
    merge = [F.expr(f"kll_merge_agg_double(s_{m}, {k})").alias(f"s_{m}") for m in METRICS]
    group = materialise(measured.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *agg), "sketches")
    lang = group.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    every = group.groupBy().agg(F.sum("n").alias("n"), *merge).where("n > 0")
    return _fences(group, ["lang", "source"], "g"), _fences(lang, ["lang"], "l"), _fences(every, [], "a")


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP, k: int = SKETCH_K, **cols: str) -> DataFrame:
    """The measures of each row, the limits that applied to it, ``reasons`` (array of metric names) and ``kept``.

    ``kept`` is false for rows that fail the base rules, and for rows with a
    reason.  Texts are read once; the joins carry numbers only.  An empty table
    gives an empty table.
    """
    m = materialise(measures(docs, **cols), "measures")
    group, lang, every = thresholds(m, k)
    df = m.alias("m").join(group.alias("g"), F.expr("m.lang <=> g.lang and m.source <=> g.source"), "left").select("m.*", *[f"g.{c}" for c in group.columns[2:]])
    df = df.alias("m").join(lang.alias("l"), F.expr("m.lang <=> l.lang"), "left").select("m.*", *[f"l.{c}" for c in lang.columns[1:]])
    # one row of numbers, whatever the size of the input
    df = df.join(F.broadcast(every), F.lit(True), "left")
    reasons = []
    for name, (side, least) in METRICS.items():
        for end in ("hi", "lo")[: 1 + (side == "both")]:
            wide = F.when(F.col("l_n") >= min_group, F.col(f"l_{name}_{end}")).otherwise(F.col(f"a_{name}_{end}"))
            own = F.col(f"g_{name}_{end}")
            if end == "hi":
                own = F.least(own, wide * STRETCH)
            limit = F.when(F.col("g_n") >= min_group, own).otherwise(wide)
            df = df.withColumn(f"{name}_{end}", limit)
            beyond = F.col(name) > F.col(f"{name}_{end}") if end == "hi" else F.col(name) < F.col(f"{name}_{end}")
            reasons.append(F.when(beyond, F.lit(name)))
    df = df.drop(*[c for c in df.columns if c[:2] in ("g_", "l_", "a_")])
    df = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    ws = r"[\x20\x09-\x0D]+"
    quart = ",\n".join(f"quantile_disc({m}, 0.25) as {m}_q1, quantile_disc({m}, 0.75) as {m}_q3" for m in METRICS)

    def level(tag: str, name: str, end: str) -> str:
        least = METRICS[name][1]
        gap = f"greatest({REACH} * ({tag}.{name}_q3 - {tag}.{name}_q1), {least})"
        return f"({tag}.{name}_q3 + {gap})" if end == "hi" else f"({tag}.{name}_q1 - {gap})"

    tests = []
    for name, (side, _) in METRICS.items():
        for end in ("hi", "lo")[: 1 + (side == "both")]:
            wide = f"(case when l.n >= {MIN_GROUP} then {level('l', name, end)} else {level('a', name, end)} end)"
            own = level("g", name, end)
            own = f"least({own}, {wide} * {STRETCH})" if end == "hi" else own
            limit = f"(case when g.n >= {MIN_GROUP} then {own} else {wide} end)"
            tests.append(f"coalesce(m.{name} {'>' if end == 'hi' else '<'} {limit}, false)")
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
p as (select doc_id, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from w where len(words) >= {WINDOW}),
win as (select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as s from p),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
cov as (select doc_id, sum(least({WINDOW}, i - coalesce(prev, -{WINDOW})))::bigint as n from
        (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from rep) group by doc_id),
b as (select w.doc_id, lang, source, len(words)::bigint as n_words,
        length(regexp_replace(text, '{ws}', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        len(regexp_extract_all(text, '\p{{Lu}}'))::bigint as n_upper,
        len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(cov.n, 0)::bigint as n_repeat_words
      from w left join cov using (doc_id)),
m as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words as base_failed,
        word_chars / greatest(n_words, 1) as mean_word, n_symbols / greatest(n_words, 1) as symbol_ratio,
        n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, n_repeat_words / greatest(n_words, 1) as repeat_ratio,
        n_upper / greatest(word_chars, 1) as upper_ratio from b),
ok as (select * from m where not base_failed),
g as (select lang, source, count(*) as n, {quart} from ok group by lang, source),
l as (select lang, count(*) as n, {quart} from ok group by lang),
a as (select count(*) as n, {quart} from ok having count(*) > 0)
select m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
  not m.base_failed and not ({' or '.join(tests)}) as kept
from m left join g on m.lang is not distinct from g.lang and m.source is not distinct from g.source
left join l on m.lang is not distinct from l.lang left join a on true
"""


ORACLE = _oracle()
