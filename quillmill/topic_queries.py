"""Queries on co-occurrence, topics and agreement of labellings, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.shared import saved
from .operators import clusters, topics
from .operators.wordpairs import Pairs
from .registry import query, table

_WORDS = r"""words as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '') as w from documents),
placed as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from words),
counts as (select t as term, count(*)::bigint as n from placed group by 1)"""
_PAIRS = f"""{_WORDS}, near as (select x.t as s, y.t as u from placed x join (select doc_id, t, i, unnest(range(1, 5)) as d from placed) y on x.doc_id = y.doc_id and x.i = y.i - y.d),
pairs as (select least(s, u) as a, greatest(s, u) as b, count(*)::bigint as n from near group by all)"""
_PMI = f"""{_PAIRS}, share as (select term, n / (select sum(n)::double from counts) as p from counts),
prob as (select a, b, n, x.p as pa, y.p as pb, n * case when a = b then 2 else 1 end / (select 2 * sum(n)::double from pairs) as pab from pairs join share x on x.term = a join share y on y.term = b),
pmi as (select *, ln(greatest(pab, 1e-9) / (pa * (pb + 1e-9))) / greatest(-ln(greatest(pab, 1e-9)), 1e-9) as npmi from prob)"""
_SCORES = f"""{_PMI}, sided as (select a as term, pa as p, pb as q, pab from pmi union all select b, pb, pa, pab from pmi where a <> b),
met as (select term, sum(ln(greatest(pab, 1e-9) / (p * (q + 1e-9))) / greatest(-ln(greatest(pab, 1e-9)), 1e-9) - (ln(1e-9) - ln(p) - ln(q + 1e-9)) / -ln(1e-9)) as x from sided group by 1),
scores as (select term, ((select count(*) from share) * (ln(1e-9) - ln(p)) - (select sum(ln(p + 1e-9)) from share)) / -ln(1e-9) + coalesce(x, 0) as score from share left join met using (term))"""


@query(f"with {_PAIRS} select a, b, n from pairs")
def word_cooccurrence(spark, sf_dir):
    return topics.cooccurrence(table(spark, sf_dir, "documents"))


@query(f"with {_PMI} select a, b, round(npmi, 6) as npmi from pmi")
def word_pair_npmi(spark, sf_dir):
    return Pairs(table(spark, sf_dir, "documents")).npmi(6).select("a", "b", "npmi")


@query(f"with {_SCORES} select term, round(score, 3) as score from scores")
def word_npmi_scores(spark, sf_dir):
    return Pairs(table(spark, sf_dir, "documents")).scores().select("term", F.round("score", 3).alias("score"))


@query(f"with {_SCORES} select (row_number() over (order by round(score, 9) desc, term) - 1)::int as rank, term from scores order by 1 limit 20")
def topic_anchors(spark, sf_dir):
    return topics.anchors(Pairs(table(spark, sf_dir, "documents")).scores(), 20).select("rank", "term")


@query()
def topic_word_weights(spark, sf_dir):
    """Every word's weights in the topics of eight anchors: iterative, so without SQL."""
    pairs = Pairs(table(spark, sf_dir, "documents"))
    chosen = saved(topics.anchors(pairs.scores(), 8))
    return topics.topic_words(saved(topics.mixtures(pairs, chosen, tolerance=1e-3, most=500)), pairs.counts).select("topic", "term", F.round("weight", 3).alias("weight"), F.round("share", 6).alias("share"))


_ROWS = """rows as (select 'lang by source' as pair, lang as t, source as f from documents union all select 'quality by toxic', quality::varchar, toxic::varchar from labels
union all select 'quality by lang', quality::varchar, lang from labels join documents using (doc_id) union all select 'status by priority', o_orderstatus, o_orderpriority from orders)"""
_TABLE = f"{_ROWS}, c as (select pair, t, f, count(*)::double as n from rows where t is not null and f is not null group by all)"


def _labellings(spark, sf_dir):
    docs, labels, orders = (table(spark, sf_dir, t) for t in ("documents", "labels", "orders"))
    named = lambda rows, pair, t, f: rows.select(F.lit(pair).alias("pair"), F.col(t).cast("string").alias("t"), F.col(f).cast("string").alias("f"))
    out = named(docs, "lang by source", "lang", "source").union(named(labels, "quality by toxic", "quality", "toxic"))
    out = out.union(named(labels.join(docs, "doc_id"), "quality by lang", "quality", "lang")).union(named(orders, "status by priority", "o_orderstatus", "o_orderpriority"))
    return clusters.contingency(out, "t", "f", "pair")


@query(f"""with {_TABLE}, g as (select pair, sum(n) as n, sum(n * (n - 1) / 2) as same from c group by 1),
r as (select pair, sum(m * (m - 1) / 2) as x, sum(-m / total * ln(m / total)) as h from (select *, sum(m) over (partition by pair) as total from (select pair, t, sum(n) as m from c group by all)) group by 1),
s as (select pair, sum(m * (m - 1) / 2) as x, sum(-m / total * ln(m / total)) as h from (select *, sum(m) over (partition by pair) as total from (select pair, f, sum(n) as m from c group by all)) group by 1),
mi as (select pair, sum(n / total * ln(n * total / (a * b))) as i from (select pair, n, sum(n) over (partition by pair, t) as a, sum(n) over (partition by pair, f) as b, sum(n) over (partition by pair) as total from c) group by 1)
select g.pair, g.n::bigint as n, round((same - r.x * s.x / (g.n * (g.n - 1) / 2)) / ((r.x + s.x) / 2 - r.x * s.x / (g.n * (g.n - 1) / 2)), 6) + 0.0 as ari, round(greatest(i, 0) / ((r.h + s.h) / 2), 6) + 0.0 as nmi from g join r using (pair) join s using (pair) join mi using (pair)""")
def labelling_agreement(spark, sf_dir):
    return clusters.agreement(_labellings(spark, sf_dir), "pair").select("pair", "n", (F.round("ari", 6) + 0.0).alias("ari"), (F.round("nmi", 6) + 0.0).alias("nmi"))


# Two found classes at most: the best matching is tried out.
@query("""with c as (select quality::varchar as t, toxic::varchar as f, count(*)::double as n from labels where quality is not null and toxic is not null group by all),
x as (select coalesce(sum(n) filter (t = f), 0) as straight, coalesce(sum(n) filter (t <> f), 0) as crossed, sum(n) as n from c)
select n::bigint as n, round(greatest(straight, crossed) / n, 6) as accuracy from x""")
def matched_label_accuracy(spark, sf_dir):
    held = clusters.contingency(table(spark, sf_dir, "labels"), "quality", "toxic")
    return clusters.matched_accuracy(held).select("n", F.round("accuracy", 6).alias("accuracy"))


@query(f"""with {_SCORES}, top as (select row_number() over (order by round(score, 9) desc, term) - 1 as rank, term from scores order by 1 limit 20),
hit as (select doc_id, arg_min(rank, i) as topic from placed join top on term = t group by 1)
select doc_id, coalesce(topic, 0)::int as topic from documents left join hit using (doc_id)""")
def topic_assignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return topics.assigned(docs, topics.anchors(Pairs(docs).scores(), 20))
