"""Incremental view maintenance over keys that are heavy or light.

The view counts and sums joined rows of lines, sales and clients (a line meets its sale, the sale its client,
the line's vendor is in the client's region) by the client's region and the day of sale. Each relation
changes by batches of inserted and deleted rows. After a batch with changes dL, dS, dC the view has changed by

    dL . S' . C'  +  L . (dS . C'  +  S . dC)          (primes: after the batch)

in signed rows: -1 for what left. Sums of signed rows are the view, so a version is a sum over the batches' logs
(merge on read), and a deletion takes its minimum or last distinct value along by counts that fall to zero.

Light keys      are joined directly as above. The stored relations are bucketed by the join key, so only changes
                are shuffled.
Heavy keys      A client of many sales has an auxiliary view of its joined lines, a sale of many lines one of its
                lines, both pre-aggregated over (day, vendor's region, item, revenue) and dealt over salts. A change
                of a heavy client meets its auxiliary view instead of S and L; a change of a heavy sale meets
                its view instead of L. Batches maintain these views by their own signed rows.
Rebalancing     A key turns heavy when a batch lifts its degree to the threshold, and its view is then built from
                the relations; it turns light when the degree falls below half of that, and its view is dropped.
                The threshold is a share of the relation, so never more than KEYS keys a relation are heavy at a time;
                only their ids, degrees and nothing else come to the driver.

Rows of keys that are ever heavy are salted wherever they are stored or shuffled, whether they are heavy or
light just then; their partners are repeated for each salt. Nothing is broadcast by this module.

Defined results: rows without their join key, a part, an amount or a vendor's region never reach the view; a null
nation has no region; revenue of a null discount is null, such a line counts but adds nothing; null items are not counted
as distinct ones; repeated rows count as often as they occur; a row whose life can't be told (null key or line
number) is always there; empty relations give no rows; other columns are left out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, table

KEYS = 500  # at most so many keys of a relation are heavy at a time
LEAST = 200  # no key of fewer rows is heavy
SALTS = 64, 1024  # of a hot key: four for each shuffle partition, within these bounds
NEVER = 127  # the batch in which rows leave that stay

FACTS = ["part", "vendor_region", "item_id", "revenue"]


def _old(batch: int) -> Column:
    return (F.col("born") < batch) & (F.col("gone") >= batch)


def _new(batch: int) -> Column:
    return (F.col("born") <= batch) & (F.col("gone") > batch)


def _sign(batch: int) -> Column:
    return F.when(F.col("born") == batch, 1).otherwise(-1)


def _changed(batch: int) -> Column:
    return (F.col("born") == batch) | (F.col("gone") == batch)


def _of(column: str, keys) -> Column:
    return F.col(column).isin(sorted(keys)) if keys else F.lit(False)


class Salts:
    """Deals rows of hot keys by other columns, and repeats their partners."""

    def __init__(self, n: int):
        self.n = n

    def of(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.n))

    def dealt(self, key: str, hot, *columns: str) -> Column:
        """The salt of a row of ``key``: by other columns for hot keys, 0 for the rest."""
        return F.when(_of(key, hot), self.of(*columns)).otherwise(F.lit(0).cast("long"))

    def every(self) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long"))

    def everywhere(self, rows: DataFrame, key: str, hot, name: str) -> DataFrame:
        """``rows`` for every salt of their key: once for light keys, n times for hot ones."""
        return rows.withColumn(name, F.explode(F.when(_of(key, hot), self.every()).otherwise(F.array(F.lit(0).cast("long")))))


def _bucketed(rows: DataFrame, *by: str) -> DataFrame:
    """Written once to the shared folder in buckets; joins on ``by`` then shuffle the other side alone."""
    spark = rows.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"quillmill_{uuid.uuid4().hex}"
    rows.repartition(n, *by).write.bucketBy(n, *by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


class Weights:
    """Which keys of a relation are heavy after each batch, and since when."""

    def __init__(self, rows: DataFrame, key: str, batches: int):
        total = rows.count()
        self.threshold = max(LEAST, -(-total // KEYS))
        often = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= self.threshold)
        self.hot = {r[0] for r in often.select(key).collect()}  # at most KEYS of them
        self.heavy: dict[int, dict[int, int]] = {}
        now: dict[int, int] = {}
        degrees = {}
        if self.hot:
            present = [F.sum(F.when(_new(b), 1).otherwise(0)).alias(f"d{b}") for b in range(-1, batches)]
            degrees = {r[0]: r[1:] for r in rows.filter(_of(key, self.hot)).groupBy(key).agg(*present).collect()}
        for b in range(-1, batches):
            now = {k: now.get(k, b) for k, d in degrees.items() if d[b + 1] >= self.threshold or (k in now and 2 * d[b + 1] >= self.threshold)}
            self.heavy[b] = now
        self.heavy[-2] = {}

    def held(self, before: int, after: int) -> set:
        """Keys heavy all the time from the one batch to the other."""
        return {k for k, since in self.heavy[after].items() if self.heavy[before].get(k) == since}

    def raised(self, batch: int) -> set:
        return set(self.heavy[batch]) - self.held(batch - 1, batch)


class View:
    """Maintains the view over lines (sale_id, vendor_region, item_id, revenue), sales (sale_id, client_id, part)
    and clients (client_id, region), each with born and gone, the batches in which a row comes and leaves
    (-1: there from the start, NEVER: stays). ``apply`` takes the batches one after the other, from -1."""

    def __init__(self, lines: DataFrame, sales: DataFrame, clients: DataFrame, batches: int, by_sale: Weights | None = None):
        self.batches, self.done = batches, -2
        partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.salts = Salts(min(max(4 * partitions, SALTS[0]), SALTS[1]))
        self.by_sale = by_sale or Weights(lines, "sale_id", batches)
        sales = sales.filter("sale_id is not null and client_id is not null and part is not null")
        self.by_client = Weights(sales, "client_id", batches)
        sale, client = self.by_sale.hot, self.by_client.hot
        self.lines = _bucketed(lines.withColumn("salt", self.salts.dealt("sale_id", sale, "item_id", "revenue")), "sale_id", "salt")
        # Sales twice: by their own key to meet lines, by the client's to meet clients.
        self.sales = _bucketed(self.salts.everywhere(sales, "sale_id", sale, "salt"), "sale_id", "salt")
        self.sales_of = _bucketed(sales.withColumn("place", self.salts.dealt("client_id", client, "sale_id")), "client_id", "place")
        held = clients.filter("client_id is not null and region is not null")
        self.clients = _bucketed(self.salts.everywhere(held, "client_id", client, "place"), "client_id", "place")
        self.logs: list[DataFrame] = []  # by batch: signed rows of the view and of heavy clients' views
        self.sale_logs: dict[int, DataFrame] = {}

    def apply(self, batch: int) -> None:
        assert batch == self.done + 1, "batches come one after the other"
        before, after = self.by_client.heavy[batch - 1], self.by_client.heavy[batch]
        kept = self.by_client.held(batch - 1, batch)
        columns = ["client_id", *FACTS, "region", "w", "kept"]

        # dL . S' . C'
        lines = self.lines.filter(_changed(batch)).withColumn("w", _sign(batch)).drop("born", "gone").hint("shuffle_hash")
        met = lines.join(self.sales.filter(_new(batch)).drop("born", "gone"), ["sale_id", "salt"])
        met = met.withColumn("place", self.salts.dealt("client_id", self.by_client.hot, "sale_id", "item_id"))
        parts = [self._with_region(met, batch, kept).select(columns)]

        if batch >= 0:
            # dS . C' + S . dC, then with L: light sales directly, heavy ones by their views.
            moved = self.sales_of.filter(_changed(batch)).withColumn("w", _sign(batch)).drop("born", "gone")
            there = self.sales_of.filter(_old(batch) & ~_of("client_id", before)).drop("born", "gone")
            turned = self.clients.filter(_changed(batch)).withColumn("w", _sign(batch)).drop("born", "gone")
            names = ["sale_id", "client_id", "part", "region", "w", "kept"]
            direct = there.join(turned.hint("shuffle_hash"), ["client_id", "place"]).withColumn("kept", F.lit(False))
            change = self._with_region(moved, batch, kept).select(names).union(direct.select(names))
            heavy_sales = self.by_sale.heavy[batch - 1]
            light = self.salts.everywhere(change.filter(~_of("sale_id", heavy_sales)), "sale_id", self.by_sale.hot, "salt")
            lines = self.lines.filter(_old(batch)).drop("born", "gone")
            parts.append(lines.join(light.hint("shuffle_hash"), ["sale_id", "salt"]).select(columns))
            if heavy_sales:
                salted = change.filter(_of("sale_id", heavy_sales)).withColumn("salt", F.explode(self.salts.every()))
                met = self.sale_view(batch - 1).withColumnRenamed("w", "n").join(salted.hint("shuffle_hash"), ["sale_id", "salt"])
                parts.append(met.withColumn("w", F.col("n") * F.col("w")).select(columns))
            if before:
                # (S . L) . dC of heavy clients: their views, as they were before the batch.
                salted = turned.filter(_of("client_id", before)).withColumnRenamed("place", "salt")  # there for every salt
                met = self.client_view(batch - 1).withColumnRenamed("w", "n").join(salted.hint("shuffle_hash"), ["client_id", "salt"])
                parts.append(met.withColumn("w", F.col("n") * F.col("w")).withColumn("kept", F.lit(False)).select(columns))

        raised = self.by_client.raised(batch)
        if raised:
            sales = self.sales_of.filter(_new(batch) & _of("client_id", raised)).drop("born", "gone", "place")
            lines = self.lines.filter(_new(batch)).drop("born", "gone")
            whole = lines.join(self.salts.everywhere(sales, "sale_id", self.by_sale.hot, "salt").hint("shuffle_hash"), ["sale_id", "salt"])
            parts.append(whole.select("client_id", *FACTS, F.lit(None).cast("int").alias("region"), F.lit(1).alias("w"), F.lit(True).alias("kept")))

        # A row is of the view (region) or of a heavy client's view (kept).
        rows = reduce(DataFrame.union, parts).filter("kept or region = vendor_region")
        rows = rows.groupBy("client_id", *FACTS, "region", "kept").agg(F.sum("w").alias("w")).filter("w <> 0")
        self.logs.append(saved(rows.select(F.lit(batch).alias("batch"), "*", self.salts.of("part", "item_id", "revenue").alias("salt"))))
        self._maintain_sale_views(batch)
        self.done = batch
        assert set(after) == kept | raised

    def _with_region(self, rows: DataFrame, batch: int, kept) -> DataFrame:
        """Rows (client_id, place) meet the clients there after the batch; those of ``kept`` clients also go
        on without a region, as rows of the client's view."""
        present = self.clients.filter(_new(batch)).drop("born", "gone").hint("shuffle_hash")
        if not kept:
            return rows.join(present, ["client_id", "place"]).withColumn("kept", F.lit(False))
        both = rows.withColumn("kept", F.explode(F.when(_of("client_id", kept), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        both = both.withColumn("place", F.when(F.col("kept"), -1 - F.col("place")).otherwise(F.col("place")))  # meets no client
        return both.join(present, ["client_id", "place"], "left").filter("kept or region is not null")

    def _maintain_sale_views(self, batch: int) -> None:
        kept, raised = self.by_sale.held(batch - 1, batch), self.by_sale.raised(batch)
        if not kept and not raised:
            return
        rows = self.lines.filter(_changed(batch) & _of("sale_id", kept)).withColumn("w", _sign(batch))
        rows = rows.union(self.lines.filter(_new(batch) & _of("sale_id", raised)).withColumn("w", F.lit(1)))
        rows = rows.groupBy("sale_id", "vendor_region", "item_id", "revenue").agg(F.sum("w").alias("w"))
        self.sale_logs[batch] = saved(rows.select("*", self.salts.of("item_id", "revenue").alias("salt")))

    def sale_view(self, batch: int) -> DataFrame:
        """(sale_id, vendor_region, item_id, revenue, salt, w): lines of heavy sales after the batch."""
        parts = []
        for b, log in self.sale_logs.items():
            if b <= batch:
                parts.append(log.filter(_of("sale_id", {k for k, since in self.by_sale.heavy[batch].items() if since <= b})))
        return reduce(DataFrame.union, parts)

    def client_view(self, batch: int) -> DataFrame:
        """(client_id, facts, salt, w): joined lines of heavy clients after the batch, whatever their region."""
        parts = []
        for b, log in zip(range(-1, batch + 1), self.logs, strict=False):
            parts.append(log.filter(F.col("kept") & _of("client_id", {k for k, since in self.by_client.heavy[batch].items() if since <= b})))
        return reduce(DataFrame.union, parts).select("client_id", *FACTS, "salt", "w")

    def rows(self) -> DataFrame:
        """(batch, region, client_id, facts, w): the view's signed rows so far."""
        return reduce(DataFrame.union, self.logs).filter(~F.col("kept"))

    def versions(self) -> DataFrame:
        """The view after each batch from 0 on, a row for each group that isn't empty."""
        of = {"client": "client_id", "item": "item_id", "revenue": "revenue"}
        values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("value")) for k, c in of.items()]))
        signed = self.rows().select("batch", "region", "part", "w", values.alias("v")).select("batch", "region", "part", "w", "v.kind", "v.value")
        versions = range(self.done + 1)
        counted = signed.groupBy("region", "part", "kind", "value").agg(*[F.sum(F.when(F.col("batch") <= b, F.col("w")).otherwise(0)).alias(f"n{b}") for b in versions])

        def made(b: int) -> list[Column]:
            n = F.col(f"n{b}")

            def of_kind(kind: str, then: Column) -> Column:
                return F.when((F.col("kind") == kind) & (n > 0), then)

            return [
                F.sum(of_kind("client", n)).alias(f"lines{b}"),
                F.sum(of_kind("revenue", n * F.col("value"))).alias(f"revenue{b}"),
                F.min(of_kind("revenue", F.col("value"))).alias(f"least{b}"),
                F.count(of_kind("client", F.col("value"))).alias(f"clients{b}"),
                F.count(of_kind("item", F.col("value"))).alias(f"items{b}"),
            ]

        groups = counted.groupBy("region", "part").agg(*[c for b in versions for c in made(b)])
        each = [F.struct(F.lit(b).alias("batch"), F.col(f"lines{b}").alias("n_lines"), F.col(f"revenue{b}").alias("revenue"), F.col(f"least{b}").alias("min_revenue"), F.col(f"clients{b}").alias("n_clients"), F.col(f"items{b}").alias("n_items")) for b in versions]
        out = groups.select("region", "part", F.explode(F.array(*each)).alias("v")).filter("v.n_lines > 0")
        return out.select("v.batch", "region", "part", "v.n_lines", "v.revenue", "v.min_revenue", "v.n_clients", "v.n_items")


# ---------------------------------------------------------------- the shop's tables as relations with lives

BATCHES = 7


def lived(rows: DataFrame, name: Column) -> DataFrame:
    """Adds born and gone by the crc32 of a row's name."""
    h = F.crc32(name.cast("binary"))
    a, d = (h % 7).cast("byte"), (F.floor(h / 7) % 7).cast("byte")
    passing = F.coalesce(a < d, F.lit(False))
    return rows.withColumn("born", F.when(passing, a).otherwise(F.lit(-1).cast("byte"))).withColumn("gone", F.when(passing, d).otherwise(F.lit(NEVER).cast("byte")))


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(keyed lines, lines with their vendor's region, sales, clients)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region"))
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", "nation_id").join(nation, "nation_id").select("vendor_id", F.col("region").alias("vendor_region")).filter("vendor_region is not null")
    cents, off = F.floor(100 * F.col("amount") + 0.5), F.floor(100 * F.col("discount") + 0.5)
    lines = table(spark, sf_dir, "sale_lines").filter("amount is not null and sale_id is not null and vendor_id is not null")
    lines = lived(lines, F.concat(F.lit("l"), "sale_id", F.lit(":"), "line_no"))
    priced = lines.select("sale_id", "vendor_id", "item_id", (cents * (100 - off)).alias("revenue"), "born", "gone")
    placed = priced.join(vendors.hint("shuffle_hash"), "vendor_id").drop("vendor_id")
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id", F.unix_date(F.col("sold_at").cast("date")).cast("long").alias("part"))
    clients = table(spark, sf_dir, "clients").select("client_id", "nation_id").join(nation, "nation_id").select("client_id", "region")
    return lines.select("sale_id", "born", "gone"), placed, lived(sales, F.concat(F.lit("s"), "sale_id")), lived(clients, F.concat(F.lit("c"), "client_id"))


def op11_view_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the view after each of the seven batches."""
    keyed, lines, sales, clients = relations(spark, sf_dir)
    view = View(lines, sales, clients, BATCHES, Weights(keyed, "sale_id", BATCHES))
    for batch in range(-1, BATCHES):
        view.apply(batch)
    return view.versions()


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ord(c)::bigint)), lambda a, c: xor(a >> 8, t[1 + (xor(a, c) & 255)])))"


def _life(name: str) -> str:
    return f"(select {{0}}, h % 7 as a, (h // 7) % 7 as d from (select *, {_CRC.format(name)} as h from {{1}}, steps))"


ORACLE = f"""with steps as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))),
l as {_life("'l' || sale_id || ':' || line_no").format("sale_id, vendor_id, item_id, amount, discount", "sale_lines")},
s as {_life("'s' || sale_id").format("sale_id, client_id, sold_at", "sales")},
c as {_life("'c' || client_id").format("client_id, nation_id", "clients")},
joined as (select l.a as la, l.d as ld, s.a as sa, s.d as sd, c.a as ca, c.d as cd, n.n_regionkey as region, date_diff('day', date '1970-01-01', s.sold_at::date) as part, s.client_id, l.item_id,
    (floor(100 * l.amount + 0.5) * (100 - floor(100 * l.discount + 0.5)))::bigint as revenue
  from l join s on l.sale_id = s.sale_id join c on s.client_id = c.client_id join vendors v on l.vendor_id = v.vendor_id
  join nation n on c.nation_id = n.n_nationkey join nation m on v.nation_id = m.n_nationkey where n.n_regionkey = m.n_regionkey and l.amount is not null and s.sold_at is not null)
select b::int as batch, region, part::bigint as part, count(*)::bigint as n_lines, sum(revenue)::bigint as revenue, min(revenue) as min_revenue, count(distinct client_id)::bigint as n_clients, count(distinct item_id)::bigint as n_items
from joined, range(7) r(b)
where coalesce(la >= ld or (la <= b and b < ld), true) and coalesce(sa >= sd or (sa <= b and b < sd), true) and coalesce(ca >= cd or (ca <= b and b < cd), true) group by b, region, part"""
