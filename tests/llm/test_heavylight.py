"""The maintained view against joining all rows anew after each batch, and against SQL."""

import random
from collections import defaultdict

import duckdb
import pytest

from quillmill.llm import heavylight as H
from quillmill.llm.queries import ORACLE_SQL, QUERIES

LINES = "sale_id long, vendor_region int, item_id long, revenue long, born byte, gone byte"
SALES = "sale_id long, client_id long, part long, born byte, gone byte"
CLIENTS = "client_id long, region int, born byte, gone byte"


def anew(lines, sales, clients, batches):
    out = set()
    for b in range(batches):
        here = lambda r, b=b: r[-2] <= b < r[-1]
        groups = defaultdict(list)
        by_client, by_sale = defaultdict(list), defaultdict(list)
        for c in filter(here, clients):
            by_client[c[0]].append(c[1])
        for s in filter(here, sales):
            by_sale[s[0]].append((s[1], s[2]))
        for sale, region, item, revenue, *_ in filter(here, lines):
            for client, part in by_sale.get(sale, []) if sale is not None else []:
                for r in by_client.get(client, []) if client is not None and part is not None else []:
                    if r is not None and r == region:
                        groups[r, part].append((client, item, revenue))
        for (r, part), rows in groups.items():
            priced = [x[2] for x in rows if x[2] is not None]
            out.add((b, r, part, len(rows), sum(priced) if priced else None, min(priced, default=None), len({x[0] for x in rows}), len({x[1] for x in rows} - {None})))
    return out


def life(rng, batches):
    if rng.random() < 0.4:
        return (-1, H.NEVER)
    a = rng.randrange(-1, batches - 1)
    return (a, rng.choice([H.NEVER, rng.randrange(a + 1, batches)]))


def made(seed, batches):
    """A third of the lines has sale 7, half of the sales client 3; both come and go in waves."""
    rng = random.Random(seed)
    lines, sales, clients = [], [], []
    for i in range(400):
        sale = 7 if i % 3 == 0 else rng.choice([None, *range(60)])
        when = (1, 3 + i % 2) if sale == 7 and i % 2 else life(rng, batches)
        lines.append((sale, rng.randrange(2), rng.choice([None, *range(9)]), rng.choice([None, *range(1, 40)]), *when))
    lines += [lines[0], lines[1], lines[1]]
    for s in range(60):
        client = 3 if s % 2 else rng.choice([None, *range(12)])
        when = (0, 2 + s % 3) if client == 3 and s % 5 else life(rng, batches)
        sales.append((s, client, rng.choice([None, 1, 2, 3]), *when))
    sales.append((7, 5, 2, *life(rng, batches)))
    clients += [(c, rng.choice([None, 0, 1, 1]), *life(rng, batches)) for c in range(12) for _ in range(1 + (c == 4))]
    clients += [(3, 1, 0, 2), (3, 0, 2, 4), (3, 1, 4, H.NEVER)]
    return lines, sales, clients


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_joining_anew(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "LEAST", 12)
    batches = 5
    tables = made(seed, batches)
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, (LINES, SALES, CLIENTS), strict=True)]
    view = H.View(*frames, batches)
    for b in range(-1, batches):
        view.apply(b)
    # Keys turn heavy and light again on the way, and some stay heavy over batches.
    assert {7} <= view.by_sale.hot and {3} <= view.by_client.hot
    assert any(view.by_client.raised(b) for b in range(batches)) and any(view.by_client.held(b - 1, b) for b in range(batches))
    assert any(set(view.by_client.heavy[b - 1]) - set(view.by_client.heavy[b]) for b in range(batches))
    assert view.sale_logs
    assert {tuple(r) for r in view.versions().collect()} == anew(*tables, batches)


def test_only_light_keys(spark):
    tables = made(3, 4)
    view = H.View(*[spark.createDataFrame(t, s) for t, s in zip(tables, (LINES, SALES, CLIENTS), strict=True)], 4)
    for b in range(-1, 4):
        view.apply(b)
    assert not view.by_sale.hot and not view.by_client.hot
    assert {tuple(r) for r in view.versions().collect()} == anew(*tables, 4)


def test_changes_alone_are_shuffled(spark):
    """Joins with lines read them by bucket: no exchange stands over their scan."""
    tables = made(3, 4)
    view = H.View(*[spark.createDataFrame(t, s) for t, s in zip(tables, (LINES, SALES, CLIENTS), strict=True)], 4)
    joined = view.lines.join(view.sales.hint("shuffle_hash"), ["sale_id", "salt"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


TABLES = "sale_lines sales clients vendors nation".split()


def in_order(row):
    return tuple((x is None, x) for x in row)


def compared(spark, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    got = QUERIES["op11_view_maintenance"](spark, folder)
    want = con.sql(ORACLE_SQL["op11_view_maintenance"])
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect()), key=in_order), sorted(want.fetchall(), key=in_order)


@pytest.mark.parametrize("least", [10, 1000])
def test_query_equals_sql(spark, monkeypatch, least):
    monkeypatch.setattr(H, "LEAST", least)
    got, want = compared(spark, "/root/testdata/sf0.001")
    assert got == want and {r[0] for r in got} == set(range(7))


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, extra columns with clashing names, then no rows at all."""
    sf, folder, none = "/root/testdata/sf0.001", f"{tmp_path}/odd", f"{tmp_path}/none"
    for t in TABLES:
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        blank = spark.createDataFrame([(None,) * len(rows.columns)], rows.schema)
        first = rows.limit(3)
        odd = rows.union(blank).union(first if t != "nation" else blank)
        odd.selectExpr("*", "1 as salt", "'x' as born", "2 as region").write.parquet(f"{folder}/{t}.parquet")
        odd.limit(0).write.parquet(f"{none}/{t}.parquet")
    got, want = compared(spark, folder)
    assert got == want and got
    assert QUERIES["op11_view_maintenance"](spark, none).collect() == []
