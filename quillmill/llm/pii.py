"""Personal data: pattern spans, and terms that disclose them, in DataFrame operations alone.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Beyond them the
corpus itself is asked which ordinary terms reveal a protected entity. Entities are single values (one
address, one number) and what several values share: an e-mail's domain, an IPv4 address's first three
numbers, a card's issuer digits, a phone number's block. Term t discloses entity e as far as its
pointwise mutual information with e reaches e's own information content, PMI(t; e) >= ALPHA * IC(e).
All counts are of distinct texts, over the whole corpus: n(t) of those that hold t, n(e) of those that
hold e, n(t, e) of those that hold both anywhere, SUPPORT at least; so copies of a text count once on
every side, and a frame that is the same everywhere counts as often as it stands. Shared entities are
common enough to meet rare words by chance: theirs also need n(t, e) * PMI >= 2 * ln(number of texts).
A text's terms are its words of SHORTEST letters or more outside base spans. Disclosing terms are spans
of kind ``term`` in every document that holds the entity; :func:`sanitise` removes them, or generalises
them to their class (<NAME> for capitalised words, <NUMBER> for those with digits) where that class
does not itself disclose the entity, and generalises base spans to their kind.

Defined results: null texts are empty; positions are code points, end exclusive; spans at one start stand
by kind; of overlapping spans the one that starts first stands for all in a sanitised text; equal rows give
equal results; an empty table gives no rows; extra columns pass through :func:`sanitise`, whatever their
names. A text of any length costs time in proportion to its length and to its number of spans.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved, table, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
ALPHA, SUPPORT, SHORTEST = 0.9, 3, 4
#: A side of a join is broadcast up to so many rows of a hash or an id; beyond, the join shuffles.
SMALL = 100_000

# Possessive quantifiers and anchors at the start of a run give the contract's leftmost matches
# without retrying every position inside a long run (\\G: right after the previous match). A card's
# matches are whole runs of digits with single separators; those of another length fail, so the
# pattern passes over them.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD_GAP = r"[^\p{L}\p{N}]+"


# Expressions are built as SQL text: Python only writes them, the JVM parses each one once.
_names = itertools.count()
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
NO_SPANS = f"cast(array() as {SPAN})"
BLOCK, PART = 128, 256


def each(function: str, values: str, body) -> str:
    """``function(values, x -> body(x))`` with a name of its own for x."""
    x = f"v{next(_names)}"
    return f"{function}({values}, {x} -> {body(x)})"


def paired(left: str, right: str, body) -> str:
    x, y = f"v{next(_names)}", f"v{next(_names)}"
    return f"zip_with({left}, {right}, ({x}, {y}) -> {body(x, y)})"


def let(value: str, body) -> str:
    """``body(value)`` with ``value`` worked out once."""
    return f"element_at({each('transform', f'array({value})', body)}, 1)"


def running(values: str, combine) -> str:
    """What ``combine`` (with 0 as its neutral element) makes of the elements before each one of ``values``.

    A fold that appends copies its array at each step, so values are folded in blocks, and blocks' totals
    are folded on top: n * BLOCK + (n / BLOCK) ** 2 copies for n values.
    """

    def within(block):
        return f"aggregate({block}, struct(0 as at, cast(array() as array<int>) as out), (a, v) -> struct({combine('a.at', 'v')} as at, concat(a.out, array(a.at)) as out), a -> a.out)"

    def blocked(parts):
        totals = each("transform", parts, lambda p: f"aggregate({p}, 0, (a, v) -> {combine('a', 'v')})")
        return f"flatten({paired(parts, within(totals), lambda p, before: each('transform', within(p), lambda x: combine(before, x)))})"

    def folded(whole):
        cut = each("transform", f"sequence(0, cast((size({whole}) - 1) / {BLOCK} as int))", lambda b: f"slice({whole}, {b} * {BLOCK} + 1, {BLOCK})")
        return f"if(size({whole}) <= {BLOCK}, {within(whole)}, {let(cut, blocked)})"

    return let(values, folded)


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    def add(d):
        step = f"cast(substring({d}, length({d}) - i + 1, 1) as int) * if(i % 2 = 0, 2, 1)"
        return f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + {step} - if({step} > 9, 9, 0)) % 10 = 0"

    return let(digits, add)


def _valid(kind: str, value: str) -> str:
    if kind == "ip":
        small = each("transform", rf"split({value}, r'\.')", lambda p: f"regexp_replace({p}, '^0+(?=[0-9])', '')")
        return each("forall", small, lambda p: f"(length({p}) <= 3 and cast(substring({p}, 1, 3) as int) <= 255)")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return f"length({_digits(value)}) between 10 and 15"
    return "true"


def spans_of(text: str, pattern: str, kind: str, order: int) -> str:
    """Spans of all matches: lengths of the pieces between matches give positions."""

    def placed(found):
        def from_gaps(gaps):
            before = running(paired(gaps, found, lambda g, h: f"length({g}) + length({h})"), lambda a, b: f"{a} + {b}")
            starts = paired(gaps, before, lambda g, b: f"length({g}) + {b}")
            return paired(starts, found, lambda at, h: f"struct({at} as start, {order} as ord, {at} + length({h}) as end, '{kind}' as kind, {h} as value)")

        return f"if(size({found}) > 0, {let(f'slice(split({text}, {pattern}, -1), 1, size({found}))', from_gaps)}, {NO_SPANS})"

    return let(f"regexp_extract_all({text}, {pattern}, 0)", placed)


def base_spans(text: str) -> str:
    """All base spans by start, then kind."""
    kinds = []
    for order, kind in enumerate(KINDS):
        spans = each("filter", spans_of(text, f"r'{PATTERNS[kind]}'", kind, order), lambda s, kind=kind: _valid(kind, f"{s}.value"))
        mark = {"email": "@", "phone": "+"}.get(kind)
        kinds.append(f"if(contains({text}, '{mark}'), {spans}, {NO_SPANS})" if mark else spans)
    return f"if({text} rlike '[0-9@]', array_sort(concat({', '.join(kinds)})), {NO_SPANS})"


def replaced(text: str, spans: str, mark) -> str:
    """``text`` with ``mark(span)`` for spans (sorted); of overlapping ones the first stands for all.

    The text is cut once into parts of PART code points, as taking a substring reads from the start.
    """

    def between(parts, a, b):
        first = f"cast(floor({a} / {PART}) as int)"
        near = f"array_join(slice({parts}, {first} + 1, cast(floor({b} / {PART}) as int) - {first} + 1), '')"
        return f"if({b} > {a}, substring({near}, {a} - {first} * {PART} + 1, {b} - {a}), '')"

    def marked(spans):
        def joined(x):  # x.ends: the furthest end of the spans before each one, and of all
            piece = lambda at, s: f"if({s}.start >= {at}, concat({between(f'{x}.parts', at, f'{s}.start')}, {mark(s)}), '')"
            pieces = paired(f"slice({x}.ends, 1, size({spans}))", spans, piece)
            return f"concat(array_join({pieces}, ''), {between(f'{x}.parts', f'element_at({x}.ends, -1)', f'length({text})')})"

        ends = running(f"concat(transform({spans}, s -> s.end), array(0))", lambda a, b: f"greatest({a}, {b})")
        cut = f"regexp_extract_all({text}, r'(?s).{{1,{PART}}}', 0)"
        return f"if(size({spans}) > 0, {let(f'struct({cut} as parts, {ends} as ends)', joined)}, {text})"

    return let(spans, marked)


def _entities(base: str) -> str:
    """The distinct (entity, shared) of base spans: one number for each protected value, whatever its
    punctuation and case, and for what it shares with others."""

    def one(s, shared):
        digits, low = _digits(f"{s}.value"), f"lower({s}.value)"
        if shared:
            value = f"case {s}.kind when 'email' then substring_index({low}, '@', -1) when 'ip' then substring_index({low}, '.', 3) when 'card' then substring({digits}, 1, 6) else substring({digits}, 1, length({digits}) - 4) end"
        else:
            value = f"if({s}.kind in ('card', 'phone'), {digits}, {low})"
        return f"xxhash64({s}.kind, {str(shared).lower()}, {value})"

    # Distinct numbers are found by hashing; distinct structs would be compared one by one.
    of = lambda shared: f"transform(array_distinct({each('transform', base, lambda s: one(s, shared))}), e -> struct(e as entity, {str(shared).lower()} as shared))"
    return f"concat({of(False)}, {of(True)})"


#: Classes of words that a term can be generalised to. No word holds these marks, so classes are counted like terms.
NAME, NUMBER = "<NAME>", "<NUMBER>"


def _class_of(word: str) -> str:
    return f"case when {word} rlike '[0-9]' then '{NUMBER}' when {word} rlike r'^\\p{{Lu}}' then '{NAME}' end"


LETTER = r"[\p{L}\p{N}]"
#: A text holds a class if some word of SHORTEST letters and more is of it.
HOLDS = {
    NUMBER: rf"(?<!{LETTER})(?={LETTER}*[0-9])(?={LETTER}*\p{{L}}){LETTER}{{{SHORTEST},}}",
    NAME: rf"(?<!{LETTER})\p{{Lu}}(?!{LETTER}*[0-9]){LETTER}{{{SHORTEST - 1},}}",
}


def _terms(text: str, base: str, every_word: bool = False) -> str:
    """The distinct words of a text outside its base spans that can be terms (or all), and their classes."""

    def of(rest):
        words = f"split(lower({rest}), r'{WORD_GAP}')"
        if not every_word:
            words = each("filter", words, lambda w: rf"(length({w}) >= {SHORTEST} and {w} rlike r'\p{{L}}')")
        classes = ", ".join(f"if({rest} rlike r'{HOLDS[c]}', array('{c}'), cast(array() as array<string>))" for c in HOLDS)
        return f"concat(array_distinct({words}), {classes})"

    return let(replaced(text, base, lambda s: "' '"), of)


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= SMALL else side


def disclosing_terms(rows: DataFrame, keyed: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term) pairs over the threshold; term may be a class. ``rows``: (k, x, entities) of each row, x a hash of its text."""
    texts = saved(rows.groupBy("x").agg(F.min("k").alias("k"), F.count("*").alias("copies"), F.first("entities").alias("entities")))
    held = texts.select("k", F.inline("entities"))
    n_e = saved(held.groupBy("entity", "shared").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support))  # n_te is n_e at most
    none = n_e.select("entity", F.lit("").alias("term")).limit(0)
    if n_e.isEmpty():
        return none
    worded = lambda side: keyed.join(_small(saved(side)), "k").withColumn("terms", F.expr(let(base_spans("text"), lambda base: _terms("text", base)))).drop("text").dropDuplicates(["k"])
    pairs = worded(held.join(_small(n_e.select("entity")), "entity").groupBy("k").agg(F.collect_list("entity").alias("entities")))
    pairs = pairs.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term"))
    joint = saved(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support))
    if joint.isEmpty():
        return none
    # Every row counts, and then a copied text's further copies are taken off.
    asked = saved(joint.select(F.xxhash64("term").alias("h")).distinct())
    asked = F.broadcast(asked) if asked.count() <= SMALL else None
    wanted = lambda hashes: hashes if asked is None else hashes.join(asked, "h", "left_semi")
    hashed = lambda terms: F.explode(F.transform(terms, lambda w: F.xxhash64(w))).alias("h")
    n_t = wanted(keyed.select(hashed(F.expr(let(base_spans("text"), lambda base: _terms("text", base, every_word=True)))))).groupBy("h").agg(F.count("*").alias("n_t"))
    more = wanted(worded(texts.filter("copies > 1").select("k", "copies")).select(hashed(F.col("terms")), (1 - F.col("copies")).alias("n_t")))
    n_t = n_t.unionByName(more).groupBy("h").agg(F.sum("n_t").alias("n_t"))
    n = float(texts.count())
    information = F.log(F.lit(n) / F.col("n_e"))
    mutual = F.log(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    by_chance = F.col("shared") & (F.col("n_te") * mutual < 2 * F.log(F.lit(n)))
    scored = joint.withColumn("h", F.xxhash64("term")).join(n_t, "h").join(n_e, "entity")
    found = saved(scored.filter((information > 0) & (mutual >= alpha * information) & ~by_chance).select("entity", "term"))
    for done in (texts, n_e, joint):
        release(done)
    return found


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): ``rows`` (doc_id, k, base) for every row of ``docs`` (doc_id, text); ``terms``
    (k, pattern, held) for rows with disclosing terms, ``held`` the classes that disclose there too.
    k: a hash of doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"))
    keyed = keyed.withColumn("k", F.xxhash64("doc_id", "text"))
    rows = saved(keyed.withColumn("base", F.expr(base_spans("text"))).select("doc_id", "k", F.xxhash64("text").alias("x"), "base").withColumn("entities", F.expr(_entities("base"))))
    terms = disclosing_terms(rows.select("k", "x", "entities"), keyed.select("k", "text"), alpha, support)
    found = rows.select("k", F.explode("entities.entity").alias("entity"))
    is_class = lambda t: t.isin(NAME, NUMBER)
    words = F.filter("terms", lambda t: ~is_class(t))
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(words, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    per_row = found.distinct().join(terms, "entity").groupBy("k").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    terms = saved(per_row.filter(F.size(words) > 0).select("k", quoted.alias("pattern"), F.filter("terms", is_class).alias("held")))
    return rows.select("doc_id", "k", "base"), terms


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(k, added): term spans of the rows that have any."""
    few = terms.count()
    side = F.broadcast(terms) if few <= SMALL // 10 else terms
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").withColumn("k", F.xxhash64("doc_id", "text"))
    return keyed.join(side, "k").select("k", F.expr(spans_of("text", "pattern", TERM, len(KINDS))).alias("added")).dropDuplicates(["k"])


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts of base spans, their digest, all spans."""
    rows, terms = find(docs)
    if terms.isEmpty():
        rows = rows.withColumn("added", F.expr(NO_SPANS))
    else:
        rows = rows.join(_term_spans(docs, terms), "k", "left")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr(NO_SPANS))))
    return rows.select("doc_id", *[of(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size(F.coalesce("added", F.expr(NO_SPANS))).alias("n_term"))


def sanitise(docs: DataFrame, generalise: bool = False, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the same columns and rows, personal data taken out of ``text``: base spans become <KIND>,
    terms go or, with ``generalise``, become their class where it doesn't disclose."""
    rows, terms = find(docs.select("doc_id", "text"), alpha, support)
    kind = lambda s: f"concat('<', upper({s}.kind), '>')"
    if terms.isEmpty():
        return docs.withColumn("text", F.expr(replaced("text", base_spans("text"), kind)))
    k, pattern, held = unused(docs.columns, "k", "pattern", "held")
    few = terms.count()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    side = terms.select(F.col("k").alias(k), F.col("pattern").alias(pattern), F.col("held").alias(held))
    marked = docs.withColumn(k, key).join(F.broadcast(side) if few <= SMALL // 10 else side, k, "left")
    added = f"if(`{pattern}` is null, {NO_SPANS}, {spans_of('text', f'`{pattern}`', TERM, len(KINDS))})"
    coarse = lambda c: f"if({c} is null or array_contains(`{held}`, {c}), '', {c})"
    term = lambda s: let(_class_of(f"{s}.value"), coarse) if generalise else "''"
    mark = lambda s: f"if({s}.kind = '{TERM}', {term(s)}, {kind(s)})"
    every = f"array_sort(concat({base_spans('text')}, {added}))"
    return marked.withColumn("text", F.expr(replaced("text", every, mark))).select(*docs.columns)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))
