"""Charts of chart specs as SVG text, built by column expressions: axes, ticks, bars or lines, legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped

WIDTH, HEIGHT = 820, 460
LEFT, RIGHT, TOP, BOTTOM = 74, 26, 56, 96
TICKS = 5
COLOURS = ["#2f6fb0", "#d9822b", "#3c9a5f", "#b5473c"]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _at(value: Column) -> Column:
    """A coordinate with two digits."""
    return F.format_string("%.2f", value.cast("double"))


def _short(value: Column) -> Column:
    """Four digits without zeros at the end."""
    return F.regexp_replace(F.format_string("%.4g", value), r"\.0+(?=$|e)|(\.\d*?[1-9])0+(?=$|e)", "$1")


def svg(specs: DataFrame, title: Column | None = None) -> DataFrame:
    """(key, table_id, svg) of ``specs`` (key, table_id, kind, categories, series (name, values)).

    The value axis starts at zero, or below where values are negative; a chart whose values are all zero
    has an axis up to one. Null values leave their place empty.
    """
    wide, high = WIDTH - LEFT - RIGHT, HEIGHT - TOP - BOTTOM
    values = F.flatten(F.transform("series", lambda s: s["values"]))
    top = F.greatest(F.coalesce(F.array_max(values), F.lit(0.0)), F.lit(0.0))
    low = F.least(F.coalesce(F.array_min(values), F.lit(0.0)), F.lit(0.0))
    framed = specs.withColumns({"_low": low, "_top": F.when(top > low, top).otherwise(low + 1.0), "_n": F.greatest(F.size("categories"), F.lit(1)), "_s": F.greatest(F.size("series"), F.lit(1))})
    span, n, s = F.col("_top") - F.col("_low"), F.col("_n"), F.col("_s")
    y = lambda v: F.lit(TOP) + high * (F.col("_top") - v) / span
    x = lambda j: F.lit(LEFT) + wide * (j + 0.5) / n
    colour = lambda i: F.element_at(F.array(*[F.lit(c) for c in COLOURS]), i % len(COLOURS) + 1)

    def tick(i: Column) -> Column:
        v = F.col("_low") + span * i / TICKS
        line = _text('<line class="grid" x1="', str(LEFT), '" x2="', str(WIDTH - RIGHT), '" y1="', _at(y(v)), '" y2="', _at(y(v)), '"/>')
        return _text(line, '<text class="tick" x="', str(LEFT - 8), '" y="', _at(y(v) + 4), '">', _short(v), "</text>")

    def label(c: Column, j: Column) -> Column:
        turn = F.when(n > 6, _text(' transform="rotate(-28 ', _at(x(j)), " ", str(HEIGHT - BOTTOM + 18), ')"')).otherwise("")
        return _text('<text class="category" x="', _at(x(j)), '" y="', str(HEIGHT - BOTTOM + 18), '"', turn, ">", escaped(c), "</text>")

    def bars(one: Column, i: Column) -> Column:
        slot = 0.8 * wide / n / s

        def bar(v: Column, j: Column) -> Column:
            left = x(j) - 0.4 * wide / n + slot * i
            drawn = _text('<rect class="bar" x="', _at(left), '" y="', _at(y(F.greatest(v, F.lit(0.0)))), '" width="', _at(slot * 0.92), '" height="', _at(F.abs(v) * high / span), '" fill="', colour(i), '"/>')
            return F.coalesce(drawn, F.lit(""))

        return F.array_join(F.transform(one["values"], bar), "")

    def line(one: Column, i: Column) -> Column:
        point = lambda v, j: F.when(v.isNotNull(), _text(_at(x(j)), ",", _at(y(v))))
        points = F.filter(F.transform(one["values"], point), lambda p: p.isNotNull())
        dots = F.transform(points, lambda p: _text('<circle class="point" cx="', F.substring_index(p, ",", 1), '" cy="', F.substring_index(p, ",", -1), '" r="4" fill="', colour(i), '"/>'))
        return _text('<polyline fill="none" stroke="', colour(i), '" points="', F.array_join(points, " "), '"/>', F.array_join(dots, ""))

    def entry(one: Column, i: Column) -> Column:
        left = F.lit(LEFT) + 170 * i
        return _text('<rect class="key" x="', _at(left), '" y="', str(HEIGHT - 24), '" width="12" height="12" fill="', colour(i), '"/><text class="legend" x="', _at(left + 18), '" y="', str(HEIGHT - 14), '">', escaped(one["name"]), "</text>")

    marks = F.when(F.col("kind") == "line", F.array_join(F.transform("series", line), "")).otherwise(F.array_join(F.transform("series", bars), ""))
    legend = F.when(F.size("series") > 1, F.array_join(F.transform("series", entry), "")).otherwise("")
    head = title if title is not None else F.col("table_id").cast("string")
    drawn = _text(
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">',
        f'<text class="title" x="{WIDTH // 2}" y="30">', escaped(F.coalesce(head, F.lit(""))), "</text>",
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TICKS)), tick), ""),
        f'<line class="axis" x1="{LEFT}" x2="{LEFT}" y1="{TOP}" y2="{HEIGHT - BOTTOM}"/>',
        _text(f'<line class="axis" x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="', _at(y(F.lit(0.0))), '" y2="', _at(y(F.lit(0.0))), '"/>'),
        marks, F.array_join(F.transform("categories", label), ""), legend, "</svg>",
    )
    return framed.select("key", "table_id", drawn.alias("svg"))
