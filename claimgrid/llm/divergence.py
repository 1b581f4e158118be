"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gets a histogram of character classes and one of the common words of its language and all other words. References are the
summed histograms, by language, of all documents that pass the base rules. A document fails when the Jensen-Shannon
distance (square root of the divergence to base 2) of one of its histograms to the reference is above the limit; each
test has a least size below which it isn't made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.tables import WORD_GAP, query, table, written

# Common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "he", "at", "by", "from", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus"],
}
# Character classes of the histogram; what is in none of them is counted as other.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digits": "0-9", "symbols": "#*$%&|<>", "stops": ".,;:!?'\"()-", "wide": "\\x{80}-\\x{10FFFF}"}
LIMIT_CHARS, LIMIT_WORDS, LEAST_CHARS, LEAST_WORDS = 0.33, 0.3, 200, 100
LANGS = sorted(COMMON)


def _count(pattern: str) -> Column:
    """Code points of the text in a class."""
    return F.char_length(F.regexp_replace("text", f"[^{pattern}]+", "")).cast("bigint")


def _one_of(words: list[str]):
    return lambda w: w.isin(words)


def repeated_words(words: str) -> list[tuple[str, Column]]:
    """Steps, each on the columns before it: words in 5-word windows that stand twice or more, the first included.
    Only where the number of distinct windows shows that some repeat are the windows sorted."""
    size = F.size(words)
    return [
        ("_h", F.transform(words, lambda w: F.xxhash64(w))),
        ("_g", F.when(size >= 5, F.transform(F.sequence(F.lit(0), size - 5), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)])))),
        ("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))),
        ("_r", F.array_sort(F.filter(F.transform("_s", lambda x, j: F.when((F.get("_s", j - 1)["g"] == x["g"]) | (F.get("_s", j + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull()))),
        ("n_repeat_words", F.coalesce(F.aggregate(F.transform("_r", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_r", j + 1) - p, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the histogram of character classes, the language with the most common
    words (ties: first in order) and the histogram of its common words."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_w", F.array_remove(F.split("text", WORD_GAP), ""))
    for name, step in repeated_words("_w"):
        rows = rows.withColumn(name, step)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    bare = F.lower(F.replace(F.replace("text", F.lit("."), F.lit("")), F.lit(","), F.lit("")))
    rows = rows.withColumn("_lines", lines).withColumn("_short", F.filter(F.split(bare, WORD_GAP), _one_of(sorted({w for ws in COMMON.values() for w in ws}))))
    rows = rows.select(
        "doc_id", F.size("_w").cast("bigint").alias("n_words"), (F.char_length("text") - _count("\\x20\\x09-\\x0D")).cast("bigint").alias("word_chars"), F.char_length("text").alias("_all"),
        *[_count(p).alias(f"c_{name}") for name, p in CLASSES.items()], (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words", "_short")
    rows = rows.withColumn("_best", F.array_max(F.array(*[F.struct(F.size(F.filter("_short", _one_of(COMMON[x]))).alias("n"), F.lit(-i).alias("i")) for i, x in enumerate(LANGS)])))
    rows = rows.withColumn("lang_ref", F.element_at(F.array(*[F.lit(x) for x in LANGS]), (1 - F.col("_best.i")).cast("int")))
    listed = F.element_at(F.array(*[F.array(*[F.lit(w) for w in COMMON[x]]) for x in LANGS]), (1 - F.col("_best.i")).cast("int"))
    rows = rows.withColumn("_list", listed).withColumn("_hist", F.transform("_list", lambda w: F.size(F.filter("_short", lambda x: x == w)).cast("bigint")))
    rows = rows.withColumn("word_hist", F.concat("_hist", F.array(F.col("n_words") - F.col("_best.n"))))
    classes = [F.col(f"c_{name}") for name in CLASSES]
    return rows.select("doc_id", "n_words", "word_chars", F.col("c_symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "lang_ref",
                       F.array(*classes, (F.col("word_chars") - reduce(lambda a, b: a + b, classes)).cast("bigint")).alias("char_hist"), "word_hist")


def failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null when one of them is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")
    half = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct((x / F.col(f"_sum_{a}")).alias("p"), (y / F.col(f"_sum_{b}")).alias("q")))
    terms = F.transform(parts, lambda z: (half(z["p"], (z["p"] + z["q"]) / 2) + half(z["q"], (z["p"] + z["q"]) / 2)) / 2)
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, lang_ref, js_chars, js_words, kept.

    Null texts are empty; empty and very short texts fail the base rules. Repeated rows are judged each. Where no
    document of a language passes the base rules there is no reference and nothing diverges from it."""
    seen = written(measured(docs), "divergence-counts")
    width = {"char_hist": len(CLASSES) + 1, "word_hist": len(next(iter(COMMON.values()))) + 1}
    sums = seen.filter(~failed()).groupBy("lang_ref").agg(*[F.array(*[F.sum(F.col(h)[i]) for i in range(n)]).alias(f"ref_{h}") for h, n in width.items()])
    both = seen.join(F.broadcast(sums), "lang_ref", "left")  # one row for each language of COMMON at most
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    for h in ("char_hist", "word_hist", "ref_char_hist", "ref_word_hist"):
        both = both.withColumn(f"_sum_{h}", total(h))
    both = both.withColumns({"js_chars": F.when(F.col("word_chars") >= LEAST_CHARS, distance("char_hist", "ref_char_hist")), "js_words": F.when(F.col("n_words") >= LEAST_WORDS, distance("word_hist", "ref_word_hist"))})
    passed = (F.coalesce("js_chars", F.lit(0.0)) <= LIMIT_CHARS) & (F.coalesce("js_words", F.lit(0.0)) <= LIMIT_WORDS)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), "lang_ref", "js_chars", "js_words", (~failed() & passed).alias("kept"))


def _oracle() -> str:
    quote = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
    every = quote(sorted({w for ws in COMMON.values() for w in ws}))
    classes = ", ".join("length(regexp_replace(text, '[^" + p.replace("'", "''") + "]+', '', 'g'))" for p in CLASSES.values())
    best = ", ".join(f"struct_pack(n := len(list_filter(short, lambda x: list_contains({quote(COMMON[x])}, x))), i := {-i})" for i, x in enumerate(LANGS))
    lists = ", ".join(quote(COMMON[x]) for x in LANGS)
    js = lambda h: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({h}, ref_{h}), lambda z: (case when z[1] > 0 then z[1] / list_sum({h}) * log2(z[1] / list_sum({h}) / ((z[1] / list_sum({h}) + z[2] / list_sum(ref_{h})) / 2)) else 0 end + case when z[2] > 0 then z[2] / list_sum(ref_{h}) * log2(z[2] / list_sum(ref_{h}) / ((z[1] / list_sum({h}) + z[2] / list_sum(ref_{h})) / 2)) else 0 end) / 2))))"
    sums = lambda h, n: "[" + ", ".join(f"sum({h}[{i + 1}])::double" for i in range(n)) + f"] as ref_{h}"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from d),
g as (select doc_id, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' ')))) as g from w),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
n as (select doc_id, sum(k)::bigint as n_repeat_words from (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as k from r) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as wc, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_repeat_words, 0) as n_repeat_words, [{classes}] as classes,
  list_filter(list_transform(w, lambda x: lower(replace(replace(x, '.', ''), ',', ''))), lambda x: list_contains({every}, x)) as short from w left join n using (doc_id)),
b as (select *, coalesce(wc, 0) as word_chars, list_max([{best}]) as best from m),
h as (select *, [{", ".join("'" + x + "'" for x in LANGS)}][1 - best.i] as lang_ref, list_append(classes, word_chars - list_sum(classes)) as char_hist,
  list_append(list_transform([{lists}][1 - best.i], lambda x: len(list_filter(short, lambda y: y = x))), n_words - best.n) as word_hist, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
s as (select lang_ref, {sums("char_hist", len(CLASSES) + 1)}, {sums("word_hist", len(COMMON["en"]) + 1)} from h where not base_failed group by lang_ref)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed, lang_ref,
  not base_failed and (word_chars < {LEAST_CHARS} or {js("char_hist")} <= {LIMIT_CHARS}) and (n_words < {LEAST_WORDS} or {js("word_hist")} <= {LIMIT_WORDS}) as kept from h left join s using (lang_ref)"""


@query("op7_quality_rules", _oracle())
def op7(spark, sf):
    return judge(table(spark, sf, "documents")).drop("js_chars", "js_words")
