"""Registration, and the SQL fragments that the expected results are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, expected: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if expected is not None:
            ORACLES[name] = expected
        return fn
    return register


def turned(k: str) -> str:
    """Milli-degrees east of 180 W of customer ``k``."""
    return f"(({k}*137507)%360000)"


def risen(k: str) -> str:
    """Milli-degrees north of 90 S."""
    return f"(({k}*61803)%160000+10000)"


def cell_sql(k: str, res: int) -> str:
    n = 1 << (res + 2)
    return (f"(({res}::BIGINT << 52) | (({turned(k)}*{n}//360000) << 26)"
            f" | ({risen(k)}*{n}//180000))")


def lng_of(cell: str, res: int) -> str:
    n = 1 << (res + 2)
    return f"(((({cell})>>26)&67108863)+0.5)*(360.0::DOUBLE/{n})-180.0"


def lat_of(cell: str, res: int) -> str:
    n = 1 << (res + 2)
    return f"((({cell})&67108863)+0.5)*(180.0::DOUBLE/{n})-90.0"


def grid_row_sql(k: str) -> str:
    return f"((180000-{risen(k)})//500)"


def grid_col_sql(k: str) -> str:
    return f"({turned(k)}//500)"


def grid_cell_sql(k: str) -> str:
    return f"({grid_row_sql(k)}*720+{grid_col_sql(k)}+1)"


MEAN_PRICE = ("CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100")


def layer_sql(res: int) -> str:
    return (f"SELECT {cell_sql('o_custkey', res)} AS cell_id, {MEAN_PRICE} AS value, "
            f"count(*) AS n FROM orders GROUP BY 1")


def located_sql(res: int, inner: str | None = None) -> str:
    src = inner or layer_sql(res)
    return (f"SELECT cell_id, value, n, {lng_of('cell_id', res)} AS lng, "
            f"{lat_of('cell_id', res)} AS lat FROM ({src})")


def north_sql(y: str, n: str) -> str:
    return f"(atan(sinh(pi()*(1-2*({y})/{n})))*180.0/pi())"


def tiles_sql(z: int) -> str:
    """All tiles of a zoom with their boxes."""
    n = f"{2 ** z}::DOUBLE"
    return (f"SELECT {z} AS z, CAST(a.i AS INTEGER) AS x, CAST(b.i AS INTEGER) AS y, "
            f"a.i/{n}*360.0-180.0 AS w, (a.i+1)/{n}*360.0-180.0 AS e, "
            f"{north_sql('b.i+1', n)} AS s, {north_sql('b.i', n)} AS t "
            f"FROM range({2 ** z}) a(i), range({2 ** z}) b(i)")


def tiled_sql(z: int, res: int, inner: str | None = None) -> str:
    """Every tile row of a layer, by testing every cell against every tile."""
    b = 360.0 / (1 << (res + 2)) * 1.5
    w, e = f"round(w-{b},10)", f"round(e+{b},10)"
    return (f"SELECT z, x, y, cell_id, value, n FROM ({located_sql(res, inner)}) c, "
            f"({tiles_sql(z)}) g WHERE (lng BETWEEN {w} AND {e} OR lng+360 BETWEEN {w} AND {e} "
            f"OR lng-360 BETWEEN {w} AND {e}) AND lat BETWEEN round(s-{b},10) AND round(t+{b},10)")


def hexed(cell: str) -> str:
    return f"lower(to_hex({cell}))"


OCCURRENCES = (
    "SELECT l_partkey AS aphiaid, CAST(year(l_shipdate) AS INTEGER) AS date_year, o_custkey AS k, "
    "'part' AS phylum, p_type AS class, p_brand AS \"order\" "
    "FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey")

MODEL_CELLS = (
    f"SELECT p_brand||'|'||p_type AS mdl_key, {grid_cell_sql('o_custkey')} AS cell_id, "
    "sum(l_quantity) AS val FROM lineitem JOIN orders ON l_orderkey=o_orderkey "
    "JOIN part ON l_partkey=p_partkey GROUP BY 1,2")
