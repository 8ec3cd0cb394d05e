"""Pseudocode to Python text by line rules, as columns.

Every line is given a kind by the first rule that fits, its operands are cut out, and its expression
is rewritten once. A fold over the lines then places them: a kind says how far to step out before a
line, which lines it writes and how far to step in or out after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line kinds in order, with the pattern that a line must fit and, for words, its bare form.
LINE_RULES = [
    ("comment", r"^#"),
    ("input", r"(?iU)^(?:input|输入|require|requires)\s*[:：]\s*(.+)$"),
    ("output", r"(?iU)^(?:output|输出|ensure)\s*[:：]\s*(.+)$"),
    ("def", r"(?iU)^(?:function|procedure|def|algorithm)\s+([\w\-]+)\s*[(（](.*?)[)）]?\s*$"),
    ("range", r"(?iU)^for\s+(\w+)\s*(?:←|=|:=)\s*(.+?)\s+to\s+(.+?)(?:\s+by\s+(.+?))?\s*(?:do)?$"),
    ("each", r"(?iU)^for\s+each\s+(\w+)\s+in\s+(.+?)\s*(?:do)?$"),
    ("while", r"(?iU)^while\s+(.+?)\s*(?:do)?$"),
    ("repeat", r"(?i)^(?:repeat|do)[.;]*$"),
    ("until", r"(?iU)^until\s+(.+)$"),
    ("if", r"(?iU)^(?:if|when)\s+(.+?)\s*(?:then)?$"),
    ("elif", r"(?iU)^(?:else\s*if|elif|otherwise\s+if)\s+(.+?)\s*(?:then)?$"),
    ("else", r"(?i)^(?:else|otherwise|否则)[.;]*$"),
    ("end", r"(?iU)^(?:end\s*(?:for|while|if|function|procedure|loop)?|结束|fi|od)[.;]*$"),
    ("return", r"(?iU)^return\s*(.*)$"),
    ("break", r"(?i)^(?:break|中断退出)[.;]*$"),
    ("continue", r"(?i)^(?:continue|continue loop)[.;]*$"),
    ("assign", r"(?U)^([\w\[\].]+)\s*(?:←|<-|:=|=)\s*(.+)$"),
]
CALL = "call"
# Steps before and after a line of a kind; others stay where they are.
STEPS = {"def": (0, 1), "range": (0, 1), "each": (0, 1), "while": (0, 1), "repeat": (0, 1), "until": (0, -1), "if": (0, 1), "elif": (-1, 1), "else": (-1, 1), "end": (-1, 0)}
# Line numbers, leftover titles and remarks.
LINE_NUMBER = r"(?U)^\s*(?:\d+[:.)]|\d+\s)\s*"
TITLE_LINE = r"(?iU)^\s*(?:Algorithm|Alg\.?|Procedure|Pseudocode|算法)\s*[0-9]*\s*[.:：]\s*.+$"
REMARK = r"(?U)\s*[▷►▸]\s*.*$"
# Empty containers, case ignored, then signs and words of formulas.
EMPTY_VALUES = [
    (r"\bempty\s+(?:min[- ]?heap|max[- ]?heap|heap|priority\s*queue|pq)\b", "[]"),
    (r"\bempty\s+(?:set)\b", "set()"),
    (r"\bempty\s+(?:map|dict|dictionary|hash\s*table|hashtable)\b", "{}"),
    (r"\bempty\s+(?:list|array|vector|sequence|stack|queue|buffer|table)\b", "[]"),
    (r"\bempty\s+(?:string|str)\b", "''"),
    (r"\bnew\s+(?:min[- ]?heap|max[- ]?heap|heap|priority\s*queue)\b", "[]"),
    (r"\ba\s+new\s+(?:list|array|set|map|dict)\b", "[]"),
]
SIGNS = [
    (r"\\times", "*"),
    (r"\\cdot", "*"),
    (r"\\left", ""),
    (r"\\right", ""),
    (r"\\arg\s*max", "argmax"),
    (r"\\arg\s*min", "argmin"),
    (r"\\log", "math.log"),
    (r"\\exp", "math.exp"),
    (r"\\sqrt", "math.sqrt"),
    (r"\\lVert|\\rVert|\\", ""),
    (r"\bAND\b", "and"),
    (r"\bOR\b", "or"),
    (r"\bNOT\b", "not"),
    (r"\btrue\b", "True"),
    (r"\bfalse\b", "False"),
    (r"\bnil\b", "None"),
    (r"\bnull\b", "None"),
    ("≠", "!="),
    ("≤", "<="),
    ("≥", ">="),
    ("×", "*"),
    ("÷", "/"),
    ("∈", " in "),
    ("∉", " not in "),
    ("∧", " and "),
    ("∨", " or "),
    ("¬", " not "),
    ("√", "math.sqrt"),
    ("∞", "float('inf')"),
]


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def expression(text: Column) -> Column:
    """Formula signs and words as Python writes them; white space is collapsed."""
    rules = [("(?iU)" + p, v) for p, v in EMPTY_VALUES] + [("(?U)" + p, v) for p, v in SIGNS] + [(r"(?U)\s+", " ")]
    return _trim(reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, _trim(text)))


def safe_name(name: Column) -> Column:
    word = F.regexp_replace(F.regexp_replace(name, r"(?U)\W+", "_"), "^_+|_+$", "")
    return F.when(word == "", "arg").when(word.rlike(r"^\d"), F.concat(F.lit("a_"), word)).otherwise(word)


def _names(listed: Column) -> Column:
    return F.filter(F.transform(F.split(listed, "[,，;；]"), _trim), lambda p: p != "")


def _clean(lines: Column) -> Column:
    """Lines without numbers, titles and remarks; remarks of their own become comments."""
    bare = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, LINE_NUMBER, "")), lambda x: ~x.rlike(TITLE_LINE))
    noted = F.transform(F.transform(bare, _trim), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^[▷►▸]\s*", "# "), REMARK, ""))
    return F.filter(noted, lambda x: x != "")


def _kind(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), F.lit(k)) for k, p in LINE_RULES], F.lit(CALL))


def _operands(x: Column) -> Column:
    """(kind, line, a, b, c, formula): what the kind's pattern captures; formula is what gets rewritten."""
    patterns = dict(LINE_RULES)

    def part(i: int, *kinds: str) -> Column:
        found = F.lit(None).cast("string")
        for k in kinds:
            found = F.when(x["kind"] == k, F.regexp_extract(x["line"], patterns[k], i)).otherwise(found)
        return found

    formula = F.coalesce(part(1, "while", "until", "if", "elif", "return"), part(2, "assign"), F.when(x["kind"] == CALL, x["line"]))
    return F.struct(
        x["kind"].alias("kind"),
        x["line"].alias("line"),
        part(1, "input", "output", "def", "range", "each", "assign").alias("a"),
        part(2, "def", "range", "each").alias("b"),
        part(3, "range").alias("c"),
        part(4, "range").alias("d"),
        F.coalesce(expression(formula), F.lit("")).alias("value"),
    )


def _written(x: Column, inputs: Column, outputs: Column) -> Column:
    """The lines that one line becomes; all but the first stand one step further in."""
    kind, value = x["kind"], x["value"]
    line = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    given = F.when(_trim(x["b"]) != "", _trim(x["b"])).otherwise(F.array_join(F.transform(inputs, safe_name), ", "))
    head = line("def ", F.regexp_replace(x["a"], r"(?U)\W+", "_"), "(", given, "):")
    step = F.when(x["d"] != "", F.concat(F.lit(", "), _trim(x["d"]))).otherwise("")
    compared = F.when(value.contains("=="), value).otherwise(F.regexp_replace(value, "(?<![<>=!])=(?!=)", "=="))
    return (
        F.when(kind == "comment", F.array(x["line"]))
        .when(kind == "def", F.concat(head, F.transform(outputs, lambda o: F.concat(F.lit("# returns: "), o))))
        .when(kind == "range", line("for ", x["a"], " in range(", _trim(x["b"]), ", (", x["c"], ") + 1", step, "):"))
        .when(kind == "each", line("for ", x["a"], " in ", _trim(x["b"]), ":"))
        .when(kind == "while", line("while ", value, ":"))
        .when(kind == "repeat", F.array(F.lit("while True:")))
        .when(kind == "until", F.array(F.concat(F.lit("if "), value, F.lit(":")), F.lit("break")))
        .when(kind == "if", line("if ", value, ":"))
        .when(kind == "elif", line("elif ", value, ":"))
        .when(kind == "else", F.array(F.lit("else:")))
        .when(kind == "return", F.array(F.rtrim(F.concat(F.lit("return "), value))))
        .when(kind.isin("break", "continue"), F.array(kind))
        .when(kind == "assign", line(x["a"], " = ", compared))
        .when(kind == CALL, F.array(value))
        .otherwise(F.array().cast("array<string>"))
    )


def _indented(text: Column, level: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.repeat(F.lit("    "), level), text))


def _place(state: Column, x: Column) -> Column:
    steps = lambda i: F.coalesce(*[F.when(x["kind"] == k, F.lit(s[i])) for k, s in STEPS.items() if s[i]], F.lit(0))
    level = F.greatest(F.lit(0), state["level"] + steps(0))
    made = F.transform(_written(x, state["inputs"], state["outputs"]), lambda t, i: _indented(t, level + F.least(i, F.lit(1))))
    return F.struct(
        F.greatest(F.lit(0), level + steps(1)).alias("level"),
        F.when(x["kind"] == "input", _names(x["a"])).otherwise(state["inputs"]).alias("inputs"),
        F.when(x["kind"] == "output", _names(x["a"])).otherwise(state["outputs"]).alias("outputs"),
        F.concat(state["out"], made).alias("out"),
    )


def translate(algorithms: DataFrame) -> DataFrame:
    """(key, algorithm_id, code) of ``algorithms`` (key, algorithm_id, caption, lines).

    Lines without a function header are wrapped into one named after the caption; an algorithm
    without lines becomes an empty function.
    """
    none = F.array().cast("array<string>")
    title = F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption")).otherwise(F.concat(F.lit("algorithm_"), F.col("algorithm_id")))
    name = F.regexp_replace(F.left(F.regexp_replace(F.lower(title), r"(?U)\W+", "_"), F.lit(40)), "^_+|_+$", "")
    kinds = F.transform(_clean(F.coalesce("lines", none)), lambda x: F.struct(_kind(x).alias("kind"), x.alias("line")))
    start = F.struct(F.lit(0).alias("level"), none.alias("inputs"), none.alias("outputs"), none.alias("out"))
    placed = algorithms.select("key", "algorithm_id", F.when(name == "", "run").otherwise(name).alias("name"), F.transform(kinds, _operands).alias("x"))
    done = placed.withColumn("s", F.aggregate("x", start, _place))
    out, wrapped = F.col("s.out"), F.transform("s.out", lambda t: _indented(t, F.lit(1)))
    head = F.array(F.concat(F.lit("def "), F.col("name"), F.lit("("), F.array_join(F.transform("s.inputs", safe_name), ", "), F.lit("):")))
    empty = F.array(F.concat(F.lit("def "), F.col("name"), F.lit("():")), F.lit("    pass"))
    whole = F.when(F.size(out) == 0, empty).when(F.exists(out, lambda t: F.ltrim(t).startswith("def ")), out).otherwise(F.concat(head, wrapped))
    code = F.when(F.size(whole) == 1, F.concat(whole, F.array(F.lit("    pass")))).otherwise(whole)
    return done.select("key", "algorithm_id", F.array_join(code, "\n").alias("code"))
