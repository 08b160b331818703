"""Maps derived from the driver's tables, and the same relations in SQL.

Pixels come from integer keys by arithmetic that both engines do alike (nside 128, coverage 8). Prices count in whole
cents, so that sums are exact and means are one division, whatever the order of rows. Every relation is made of all rows
of its table; those that cover a part of the sky alone (ap, qp, mp, ba, bb) fold all rows into fewer pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.skymap import SkyMap

NSIDE, COVERAGE = 128, 8
N_PIX = 12 * NSIDE * NSIDE
SHIFT = 8

_A = "(l_orderkey * 7919 + l_linenumber * 104729) % 196608"
_B = "(o_orderkey * 6151) % 196608"
_M = "(l_orderkey * 6151) % 196608"
_P = "(l_orderkey * 7919 + l_linenumber * 104729) % 60000"
_W = "(l_partkey * 7919 + l_linenumber * 13) % 196608"
_CENTS = "CAST(round({} * 100) AS BIGINT)"

#: The derived relations in SQL, by name.
RELATIONS: dict[str, str] = {
    "a": f"SELECT {_A} AS pix, CAST(max({_CENTS.format('l_extendedprice')}) AS DOUBLE) AS v FROM lineitem GROUP BY 1",
    "b": f"SELECT {_B} AS pix, CAST(max({_CENTS.format('o_totalprice')}) AS DOUBLE) AS v FROM orders GROUP BY 1",
    "c": f"SELECT {_M} AS pix, CAST(max({_CENTS.format('l_extendedprice')}) AS DOUBLE) AS v FROM lineitem GROUP BY 1",
    "q": f"SELECT {_A} AS pix, max(l_quantity) AS v FROM lineitem GROUP BY 1",
    "weight": f"SELECT {_A} AS pix, CAST(max(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY 1",
    "i": f"SELECT {_A} AS pix, max(CAST(l_quantity AS BIGINT)) - 20 AS v FROM lineitem GROUP BY 1",
    "j": f"SELECT {_B} AS pix, max(o_custkey % 11) - 5 AS v FROM orders GROUP BY 1",
    "m": f"SELECT {_M} AS pix, bit_or(CAST(1 AS BIGINT) << CAST(l_suppkey % 12 AS INT)) AS v FROM lineitem GROUP BY 1",
    "n": f"SELECT {_B} AS pix, bit_or(CAST(1 AS BIGINT) << CAST(o_custkey % 12 AS INT)) AS v FROM orders GROUP BY 1",
    "w": f"SELECT {_W} AS pix, bit_or(CASE WHEN l_suppkey % 96 < 60 THEN CAST(1 AS BIGINT) << CAST(l_suppkey % 96 AS INT) ELSE 0 END) AS w0, bit_or(CASE WHEN l_suppkey % 96 >= 60 THEN CAST(1 AS BIGINT) << CAST(l_suppkey % 96 - 60 AS INT) ELSE 0 END) AS w1 FROM lineitem GROUP BY 1",
    "r": f"SELECT {_A} AS pix, CAST(max({_CENTS.format('l_extendedprice')}) AS DOUBLE) AS price, CAST(max(l_linenumber) AS INT) AS line FROM lineitem GROUP BY 1",
    "ap": f"SELECT {_P} AS pix, CAST(max({_CENTS.format('l_extendedprice')}) AS DOUBLE) AS v FROM lineitem GROUP BY 1",
    "qp": f"SELECT {_P} AS pix, max(l_quantity) AS v FROM lineitem GROUP BY 1",
    "mp": "SELECT (l_orderkey * 6151) % 2048 AS pix, bit_or(CAST(1 AS BIGINT) << CAST(l_suppkey % 12 AS INT)) | 4096 AS v FROM lineitem GROUP BY 1",
    "big": f"SELECT {_B} AS pix, max((o_orderkey % 1000 - 500) * CAST(9007199254740993 AS BIGINT) + o_custkey) AS v FROM orders GROUP BY 1",
    "ba": f"SELECT DISTINCT {_P} AS pix FROM lineitem",
    "bb": "SELECT DISTINCT 30000 + (o_orderkey * 6151) % 60001 AS pix FROM orders",
    "spots": "SELECT event_id, ((event_id * 137508) % 360000) / 1000.0 AS ra, ((event_id * 7919) % 100000) / 50000.0 - 1 AS z FROM events",
    "pts": "SELECT event_id, (event_id * 7919) % 196608 AS pix FROM events",
}
RELATIONS["spots"] = RELATIONS["spots"].replace("/ 1000.0", "/ CAST(1000 AS DOUBLE)").replace("/ 50000.0", "/ CAST(50000 AS DOUBLE)")


def with_relations(body: str, *names: str, more: str = "") -> str:
    """SQL of `body` with the named relations before it; `more` holds further ones that build on them."""
    parts = [f"{n} AS (\n  {RELATIONS[n]}\n)" for n in names] + ([more.strip()] if more else [])
    return "WITH " + ", ".join(parts) + "\n" + body.strip()


class Tables:
    """The derived maps of one data folder, each made anew from its table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def relation(self, name: str, table: str) -> DataFrame:
        """A relation's SQL over its table."""
        return self.spark.sql(RELATIONS[name].replace(f"FROM {table}", "FROM {t}"), t=self.table(table))

    def _map(self, name: str, table: str, dtype: object, coverage: int = COVERAGE, **how: object) -> SkyMap:
        return SkyMap.from_frame(self.relation(name, table), coverage, NSIDE, dtype, **how)

    def a(self, coverage: int = COVERAGE) -> SkyMap:
        return self._map("a", "lineitem", "float64", coverage)

    def ap(self) -> SkyMap:
        return self._map("ap", "lineitem", "float64")

    def qp(self) -> SkyMap:
        return self._map("qp", "lineitem", "float64")

    def mp(self) -> SkyMap:
        return self._map("mp", "lineitem", "int64", sentinel=0)

    def big(self) -> SkyMap:
        return self._map("big", "orders", "int64")

    def b(self) -> SkyMap:
        return self._map("b", "orders", "float64")

    def c(self) -> SkyMap:
        return self._map("c", "lineitem", "float64")

    def q(self) -> SkyMap:
        return self._map("q", "lineitem", "float64")

    def weight(self) -> SkyMap:
        return self._map("weight", "lineitem", "float64")

    def i(self) -> SkyMap:
        return self._map("i", "lineitem", "int64")

    def j(self) -> SkyMap:
        return self._map("j", "orders", "int64")

    def m(self, dtype: str = "int64") -> SkyMap:
        return self._map("m", "lineitem", dtype, sentinel=0)

    def n(self) -> SkyMap:
        return self._map("n", "orders", "int64", sentinel=0)

    def w(self) -> SkyMap:
        return self._map("w", "lineitem", "uint8", wide_mask_maxbits=100)

    def r(self) -> SkyMap:
        return self._map("r", "lineitem", {"price": "float64", "line": "int32"}, primary="price")

    def ba(self, packed: bool = False) -> SkyMap:
        return self._map("ba", "lineitem", "bool", bit_packed=packed)

    def bb(self, packed: bool = False) -> SkyMap:
        return self._map("bb", "orders", "bool", bit_packed=packed)

    def spots(self) -> DataFrame:
        """Positions: event_id, ra in degrees, z the sine of the declination."""
        return self.relation("spots", "events")

    def pts(self) -> DataFrame:
        return self.relation("pts", "events")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str = "") -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over the derived maps, with its SQL if there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# SQL of the pixelization --------------------------------------------------------------------------------------------
def sql_pixel(source: str, nside: int, out: str = "pixelled") -> str:
    """CTEs from `source` (any columns, with z and ra) to `out`, which adds `pix` of the position at `nside`."""
    ns, k = nside, nside.bit_length() - 1
    bits = " | ".join(f"(((x >> {i}) & 1) << {2 * i}) | (((y >> {i}) & 1) << {2 * i + 1})" for i in range(k))
    return f"""
{out}_1 AS (SELECT *, (ra - 360.0 * floor(ra / 360.0)) / 90.0 AS tt, {ns} * sqrt(3.0 * (1.0 - abs(z))) AS t FROM {source}),
{out}_2 AS (SELECT *, CAST(floor({ns} * (0.5 + tt) - {ns} * CAST(0.75 AS DOUBLE) * z) AS BIGINT) AS jp, CAST(floor({ns} * (0.5 + tt) + {ns} * CAST(0.75 AS DOUBLE) * z) AS BIGINT) AS jm, least(3, CAST(floor(tt) AS BIGINT)) AS ntt FROM {out}_1),
{out}_3 AS (SELECT *, jp >> {k} AS fp, jm >> {k} AS fm, least(CAST(floor((tt - ntt) * t) AS BIGINT), {ns - 1}) AS cp, least(CAST(floor((1.0 - (tt - ntt)) * t) AS BIGINT), {ns - 1}) AS cm, abs(z) <= CAST(2 AS DOUBLE) / 3 AS belt FROM {out}_2),
{out}_4 AS (SELECT *,
  CASE WHEN belt THEN CASE WHEN fp = fm THEN (fp & 3) + 4 WHEN fp < fm THEN fp & 3 ELSE (fm & 3) + 8 END WHEN z >= 0 THEN ntt ELSE ntt + 8 END AS face,
  CASE WHEN belt THEN jm & {ns - 1} WHEN z >= 0 THEN {ns - 1} - cm ELSE cp END AS x,
  CASE WHEN belt THEN {ns - 1} - (jp & {ns - 1}) WHEN z >= 0 THEN {ns - 1} - cp ELSE cm END AS y FROM {out}_3),
{out} AS (SELECT *, CAST((face << {2 * k}) | {bits} AS BIGINT) AS pix FROM {out}_4)"""


def sql_place(source: str, nside: int, out: str = "placed") -> str:
    """CTEs from `source` (any columns, with pix) to `out`, which adds ring, jr, nr, jp, z, s (sine of co-latitude) and lon of the centres."""
    ns, k = nside, nside.bit_length() - 1
    x = " | ".join(f"(((inner_pix >> {2 * i}) & 1) << {i})" for i in range(k))
    y = " | ".join(f"(((inner_pix >> {2 * i + 1}) & 1) << {i})" for i in range(k))
    return f"""
{out}_1 AS (SELECT *, pix & {ns * ns - 1} AS inner_pix, pix >> {2 * k} AS face FROM {source}),
{out}_2 AS (SELECT *, {x} AS x, {y} AS y, CASE WHEN face < 4 THEN 2 WHEN face < 8 THEN 3 ELSE 4 END AS f_row, CASE WHEN face BETWEEN 4 AND 7 THEN 2 * (face - 4) ELSE 2 * (face % 4) + 1 END AS f_col FROM {out}_1),
{out}_3 AS (SELECT *, f_row * {ns} - x - y - 1 AS jr FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN jr < {ns} THEN jr WHEN jr > {3 * ns} THEN {4 * ns} - jr ELSE {ns} END AS nr FROM {out}_3),
{out}_5 AS (SELECT *, ((f_col * nr + x - y) % {8 * ns} + {8 * ns}) % {8 * ns} AS jp, CAST(nr AS DOUBLE) * nr / {3.0 * ns * ns} AS t FROM {out}_4),
{out}_6 AS (SELECT *, CASE WHEN jr < {ns} THEN 1.0 - t WHEN jr > {3 * ns} THEN t - 1.0 ELSE ({2 * ns} - jr) * (CAST(2 AS DOUBLE) / {3 * ns}) END AS z, CAST(45 AS DOUBLE) * jp / nr AS lon,
  CASE WHEN jr < {ns} THEN 2 * nr * (nr - 1) WHEN jr > {3 * ns} THEN {12 * ns * ns} - 2 * nr * (nr + 1) ELSE {2 * ns * (ns - 1)} + {4 * ns} * (jr - {ns}) END + CASE WHEN jr BETWEEN {ns} AND {3 * ns} THEN jp >> 1 ELSE (jp - 1) >> 1 END % (4 * nr) AS ring FROM {out}_5),
{out} AS (SELECT *, CASE WHEN jr BETWEEN {ns} AND {3 * ns} THEN sqrt((1.0 - z) * (1.0 + z)) ELSE sqrt(t * (2.0 - t)) END AS s FROM {out}_6)"""


def every_pixel(n: int = N_PIX) -> str:
    return f"SELECT range AS pix FROM range({n})"

