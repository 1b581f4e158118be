"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. Capacities (tokens at hand times the epochs allowed) are summed from the leaves
up, budgets are handed from the root down: children share their parent's budget by weight, and what a child cannot
use goes to its siblings by their weights. A child's capacity is that of its whole subtree, so a shortage is made up by
the nearest siblings first and reaches an ancestor's siblings only when the whole subtree is used up. All amounts are
integers. The sharing of one level is closed-form: children ordered by capacity / weight fill up one after another.

Each leaf then takes whole epochs and a token-prefix of one more. The order of an epoch is the MD5 of seed, epoch,
doc_id and text digest. A leaf is cut into buckets by the leading digits of that hash; only the one bucket where the
budget ends is ordered document by document, so a leaf with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrid.llm.tables import DEAL, grouped, named, query, table, written

LEVELS = ["domain", "lang", "source"]
PER_BUCKET, MOST_DIGITS = 512, 4


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children: the parent's names and ``budget``, own name, ``weight`` and ``capacity``; adds ``given``.

    With children in the order of capacity / weight, the first k are full when the rest can still get more than theirs
    by weight; the others share what is left by weight, rounded down. Weights of 0 get nothing."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity") / F.col("weight"), *[F.col(c).asc_nulls_first() for c in LEVELS if c in children.columns])
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    step = (children.filter("weight > 0 and capacity > 0").withColumn("before", F.coalesce(F.sum("capacity").over(done), F.lit(0))).withColumn("open_weight", F.sum("weight").over(rest))
            .withColumn("full", F.col("capacity") * F.col("open_weight") <= (F.col("budget") - F.col("before")) * F.col("weight")))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))
    weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    part = F.floor(left.cast("decimal(38,0)") * F.col("weight") / weight).cast("bigint")
    return step.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("before", "open_weight", "full")


def budgets(leaves: DataFrame, weights: list[tuple[Column, Column]], total: int, epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens. ``weights``: the integer weight of a node at each level, as an expression of
    its names. Returns the leaves with ``given``, the tokens each is to contribute."""
    sized = leaves.withColumn("capacity", F.col("tokens") * epochs)
    above = None
    for k, level in enumerate(LEVELS):
        path, parent = LEVELS[: k + 1], LEVELS[:k]
        nodes = sized.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weights[k].cast("bigint"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("bigint"))
        else:
            up = above.select(*[F.col(c).alias(f"up_{c}") for c in parent], F.col("given").alias("budget"))
            nodes = nodes.join(up, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in parent]).drop(*[f"up_{c}" for c in parent])
        above = share(nodes, parent)
    return above.select(*LEVELS, "given")


def mix(docs: DataFrame, domain: Column, weights: list[Column], share_of: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """Documents chosen for a mixture: all columns of docs, and ``mix_copies``, the number of times the document is taken.

    The mixture holds ``share_of[0] / share_of[1]`` of all tokens (words) of docs. Documents not taken have no row.
    A null lang or source is a leaf of its own. A null or empty text has no tokens and is never taken. Repeated rows
    are taken or left together where they fall on the same side of the budget's end; ties in the order keep all of
    the equal rows on one side, so a leaf never exceeds its budget. A weight below 1 takes the node out."""
    measured = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("key"), domain.alias("domain"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), n_tokens().alias("tokens"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    seen = written(measured.filter("tokens > 0"), "mix-tokens")
    leaves = grouped(seen, *LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).drop(DEAL)
    leaves = written(leaves, "mix-leaves")
    total = leaves.agg(F.floor(F.sum("tokens") * share_of[0] / share_of[1]).cast("bigint").alias("budget")).first().budget or 0
    given = budgets(leaves.drop("rows"), weights, total, epochs)
    same = [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in LEVELS]
    plan = written(leaves.join(given.select(*[F.col(c).alias(f"leaf_{c}") for c in LEVELS], "given"), same).select(
        F.xxhash64(*[F.coalesce(F.concat(F.lit("."), c), F.lit("")) for c in LEVELS]).alias("leaf"), F.expr("given div tokens").cast("int").alias("whole"), F.expr("given % tokens").alias("rest"),
        F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / PER_BUCKET) / 4))).cast("int").alias("digits")), "mix-plan")
    place = (seen.withColumn("leaf", F.xxhash64(*[F.coalesce(F.concat(F.lit("."), c), F.lit("")) for c in LEVELS])).join(plan, "leaf")
             .withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "id", "digest"))))
    place = written(place.withColumn("bucket", F.expr("substr(turn, 1, digits)")).select("leaf", "id", "key", "tokens", "whole", "rest", "bucket", "turn"), "mix-places")
    sums = place.groupBy("leaf", "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = sums.select("leaf", "bucket", "rest", F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket")).alias("end"), F.col("tokens").alias("here"))
    state = upto.select("leaf", "bucket", (F.col("rest") - F.col("end") + F.col("here")).alias("open"), (F.col("end") <= F.col("rest")).alias("inside")).filter("open > 0")
    marked = place.join(state, ["leaf", "bucket"], "left")
    edge = marked.filter("not inside").withColumn("sum", F.sum("tokens").over(Window.partitionBy("leaf", "bucket").orderBy("turn"))).filter("sum <= open")
    more = marked.filter("inside").select("id", "key").unionByName(edge.select("id", "key")).distinct().withColumn("one", F.lit(1))
    taken = place.select("id", "key", "whole").distinct().join(more, ["id", "key"], "left").select("id", "key", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("mix_copies")).filter("mix_copies > 0")
    back = taken.select(F.col("id").alias("_name"), F.col("key").alias("_key"), "mix_copies")
    rows = named(docs).withColumn("_name", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    return rows.join(back, ["_name", "_key"]).select("row.*", "mix_copies")


def domain_of() -> Column:
    """Sources with an even number are the web, the others reference works; anything else is unsorted."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), "^src([0-9]+)$", 1)
    return F.when(number == "", "unsorted").when(F.substring(number, -1, 1).isin("0", "2", "4", "6", "8"), "web").otherwise("reference")


def target_weights() -> list[Column]:
    """Weights of the domains, of the languages of a domain, and of the sources of a language."""
    return [
        F.when(F.col("domain") == "web", 60).when(F.col("domain") == "reference", 35).otherwise(5),
        F.when(F.col("lang") == "en", 40).when(F.col("lang").isNull(), 5).otherwise(20),
        F.lit(1),
    ]


def production(docs: DataFrame) -> DataFrame:
    return mix(docs, domain_of(), target_weights())


@query("op2_source_mixing", r"""
with d as (select doc_id, coalesce(lang, '?') as lang, coalesce(source, '?') as source, md5(coalesce(text, '')) as digest,
    case when not regexp_matches(coalesce(source, ''), '^src[0-9]+$') then 'unsorted' when right(source, 1) in ('0', '2', '4', '6', '8') then 'web' else 'reference' end as domain,
    cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as tokens from documents),
s as (select * from d where tokens > 0),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::bigint * 2 as capacity, 1 as weight from s group by all),
n2 as (select domain, lang, sum(capacity)::bigint as capacity, case lang when 'en' then 40 when '?' then 5 else 20 end as weight from leaves group by all),
n1 as (select domain, sum(capacity)::bigint as capacity, case domain when 'web' then 60 when 'reference' then 35 else 5 end as weight from leaves group by all),
b1 as (select *, (select sum(tokens)::bigint // 2 from leaves) as budget from n1),
f1 as (select *, capacity * sum(weight) over (order by capacity / weight, domain rows between current row and unbounded following) <= (budget - coalesce(sum(capacity) over (order by capacity / weight, domain rows between unbounded preceding and 1 preceding), 0)) * weight as f from b1),
g1 as (select domain, case when f then capacity else (budget - coalesce(sum(case when f then capacity end) over (), 0)) * weight // sum(case when not f then weight end) over () end as given from f1),
b2 as (select n2.*, given as budget from n2 join g1 using (domain)),
f2 as (select *, capacity * sum(weight) over (partition by domain order by capacity / weight, lang rows between current row and unbounded following) <= (budget - coalesce(sum(capacity) over (partition by domain order by capacity / weight, lang rows between unbounded preceding and 1 preceding), 0)) * weight as f from b2),
g2 as (select domain, lang, case when f then capacity else (budget - coalesce(sum(case when f then capacity end) over (partition by domain), 0)) * weight // sum(case when not f then weight end) over (partition by domain) end as given from f2),
b3 as (select leaves.*, given as budget from leaves join g2 using (domain, lang)),
f3 as (select *, capacity * sum(weight) over (partition by domain, lang order by capacity / weight, source rows between current row and unbounded following) <= (budget - coalesce(sum(capacity) over (partition by domain, lang order by capacity / weight, source rows between unbounded preceding and 1 preceding), 0)) * weight as f from b3),
g3 as (select domain, lang, source, tokens as held, case when f then capacity else (budget - coalesce(sum(case when f then capacity end) over (partition by domain, lang), 0)) * weight // sum(case when not f then weight end) over (partition by domain, lang) end as given from f3),
p as (select s.*, cast(given // held as bigint) as whole, given % held as rest, md5('17:' || cast(given // held as bigint) || ':' || coalesce(doc_id::varchar, '') || ':' || digest) as turn from s join g3 using (domain, lang, source)),
c as (select *, sum(tokens) over (partition by domain, lang, source order by turn) as upto from p)
select doc_id, tokens as n_tokens, cast(whole + (upto <= rest)::int as int) as mix_copies from c where whole + (upto <= rest)::int > 0""")
def op2(spark, sf):
    docs = table(spark, sf, "documents").withColumn("n_tokens", n_tokens())
    return production(docs).select("doc_id", "n_tokens", "mix_copies")
