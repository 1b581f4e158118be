"""License scans: sparse TF-IDF cosine of headers and licence files to templates, inherited down the directory tree.

Every line of every text is a possible header. A line can only reach the threshold if it holds a telling term: terms
are left out of that set, everyday words first, then the lightest, while all that is left out of a template stays
lighter than the threshold times its norm. Lines with a telling term are cut into terms; these are counted, weighted with the templates' inverse
document frequency and multiplied with the templates in joins with the small table of template terms. A file without
a header of its own takes the licence of the licence file in its own directory or the nearest above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.tables import query, table, written

# Header texts of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Distributed under the terms of the BSD 3-Clause License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, Version 2.0.",
}
# Everyday words that also stand in the templates.
EVERYDAY = {"0", "2", "3", "by", "is", "of", "the", "this", "to", "under", "work"}
THRESHOLD = 0.7
TERM = "[a-z0-9]+"
LICENCE_FILE = "(?i)^(licen[sc]e|copying|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def weights(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The inverse document frequency of each term, and the unit vector of each template."""
    counts = {name: Counter(terms(text)) for name, text in templates.items()}
    seen = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in seen.items()}
    vectors = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        vectors[name] = {t: n * idf[t] / norm for t, n in c.items()}
    return idf, vectors


def telling(vectors: dict[str, dict[str, float]], threshold: float = THRESHOLD) -> set[str]:
    """Terms of which a line that reaches the threshold holds at least one."""
    out = set()
    for vector in vectors.values():
        spare = 0.0
        for term, w in sorted(vector.items(), key=lambda x: (x[0] not in EVERYDAY, x[1], x[0])):
            spare += w * w
            if spare >= threshold * threshold * (1 - 1e-9):
                out.add(term)
    return out


def headers(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, line (from 1), license, cosine: for every line that reaches the threshold its best template (ties: first
    by name). ``files``: file (unique name), text."""
    idf, vectors = weights(templates)
    spark = files.sparkSession
    rows = spark.createDataFrame([(n, t, w) for n, v in sorted(vectors.items()) for t, w in sorted(v.items())], "license string, term string, weight double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    other = math.log(1 + len(templates)) + 1  # a term of no template
    pick = f"(?i)(?<![a-z0-9])({'|'.join(sorted(telling(vectors, threshold)))})(?![a-z0-9])"
    lines = files.select("file", F.posexplode(F.split(F.col("text"), "\n")).alias("at", "content")).filter(F.col("content").rlike(pick))
    bag = (lines.select("file", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all(F.lower("content"), F.lit(TERM), F.lit(0))).alias("term"))
           .groupBy("file", "line", "term").agg(F.count("*").alias("n")))
    weighed = bag.join(F.broadcast(idfs), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    dots = weighed.join(F.broadcast(rows), "term").groupBy("file", "line", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    sized = weighed.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    found = dots.join(sized, ["file", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    return found.groupBy("file", "line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("file", "line", "b.license", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, license, how, cosine, from_path for every file. ``files``: file, path, text.

    ``how`` is "header" (a line of the file), "directory" (inherited) or "none". The best line of a file counts (ties:
    first template by name). The licence of a directory is that of its licence files (best cosine, then first path).
    A null or empty text has no header; a null path inherits nothing. Paths use "/", and a file in the root has the
    directory "". Repeated file names are one file to the headers and are listed each.
    """
    best = written(headers(files.select("file", "text"), templates, threshold).groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("file", "b.license", (-F.col("b.c")).alias("cosine")), "license-headers")
    named = files.select("file", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("base"))
    own = written(named.join(best, "file", "left"), "license-files")
    places = (own.filter(F.col("base").rlike(LICENCE_FILE) & F.col("license").isNotNull()).groupBy("dir")
              .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b")).select("dir", F.struct(F.length("dir").alias("depth"), F.col("b.path").alias("from_path"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")).alias("place")))
    # a directory and all above it; only the distinct directories climb, the files join once
    climbs = own.filter("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = climbs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("up")).distinct()
    nearest = above.join(places.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max("place").alias("near"))
    joined = own.join(nearest, "dir", "left")
    how = F.when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").otherwise("none")
    return joined.select("file", F.coalesce("license", "near.license").alias("license"), how.alias("how"), F.coalesce("cosine", "near.cosine").alias("cosine"), F.when(F.col("license").isNull(), F.col("near.from_path")).alias("from_path"))


def _path() -> Column:
    """A place for each document: source / language / thousands / sixty-fours / file; the first of 64 is named LICENSE."""
    n = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 1024").cast("string"), F.expr("doc_id div 64").cast("string"), F.when(n % 64 == 0, "LICENSE").otherwise(F.concat(n.cast("string"), F.lit(".txt"))))


def _oracle() -> str:
    idf, vectors = weights(TEMPLATES)
    idfs = ", ".join(f"('{t}', {w!r}::double)" for t, w in sorted(idf.items()))
    rows = ", ".join(f"('{n}', '{t}', {w!r}::double)" for n, v in sorted(vectors.items()) for t, w in sorted(v.items()))
    return f"""
with idfs(term, idf) as (values {idfs}), tpl(license, term, weight) as (values {rows}),
f as (select doc_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 1024) || '/' || (doc_id // 64) as dir, doc_id % 64 = 0 as lic from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as content, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from f),
b as (select doc_id, line, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from l where regexp_matches(content, '(?i)licen[sc]|mozilla|bsd|mit|apache|gnu|cc|nc|terms|version|public|clause|released|distributed')),
x as (select doc_id, line, term, count(*) * coalesce(any_value(idf), {math.log(1 + len(TEMPLATES)) + 1!r}) as x from b left join idfs using (term) group by all),
n as (select doc_id, line, sqrt(sum(x * x)) as norm from x group by all),
c as (select doc_id, line, license, round(sum(x * weight) / any_value(norm), 9) as cosine from x join tpl using (term) join n using (doc_id, line) group by all),
o as (select doc_id, min(struct_pack(c := -cosine, license := license)) as b from c where cosine >= {THRESHOLD} group by doc_id),
own as (select f.doc_id, dir, lic, b.license as license, -b.c as cosine from f left join o using (doc_id)),
near as (select dir, license, cosine from own where lic and license is not null)
select own.doc_id, coalesce(own.license, near.license) as license, case when own.license is not null then 'header' when near.license is not null then 'directory' else 'none' end as how, round(coalesce(own.cosine, near.cosine), 6) as cosine
from own left join near using (dir)"""


@query("op10_license_scan", _oracle())
def op10(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("doc_id").alias("file"), _path().alias("path"), "text")
    return scan(files).select(F.col("file").alias("doc_id"), "license", "how", F.round("cosine", 6).alias("cosine"))
