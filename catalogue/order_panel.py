"""A supplier-year panel derived from order lines.

Order, customer, part and supplier tables stand in for claims: a line is a service, an
order a claim, a customer a beneficiary. The result has the column names of the yearly
supplier files, one row per ``(Suplr_NPI, year)``.

Distinct customers and orders are counted by regrouping, line -> order -> customer ->
supplier-year, with the per-line attributes folded into one bit mask. Every step
combines on the map side and shuffles on several keys, so a supplier, order or customer
that owns a large part of all lines is spread over many tasks, and no step keeps a set
of values in memory. Tables and steps that the requested columns do not need are left
out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How line attributes map to panel columns.
RACE_BY_PART_TYPE = {
    "MEDIUM": "Wht",
    "STANDARD": "Black",
    "LARGE": "Api",
    "PROMO": "Hspnc",
    "SMALL": "Natind",
    "ECONOMY": "Othr",
}
FAMILY_PART_TYPES = {
    "DME": ("MEDIUM", "STANDARD"),
    "POS": ("LARGE", "PROMO"),
    "Drug": ("SMALL", "ECONOMY"),
}
GENDER_BY_LINE_STATUS = {"F": "Feml", "O": "Male"}
AGE_BANDS = (("LT_65", 1700.0), ("65_74", 4300.0), ("75_84", 7350.0), ("GT_84", None))
CONDITION_BY_PRIORITY = {
    "1-URGENT": "PH_Asthma_V2",
    "2-HIGH": "PH_CKD_V2",
    "3-MEDIUM": "PH_COPD_V2",
}
CONDITION_BY_RETURN_FLAG = {"R": "BH_Anxiety_V1", "A": "BH_Bipolar_V1"}

TYPE_BIT = {part_type: 1 << i for i, part_type in enumerate(RACE_BY_PART_TYPE)}
STATUS_BIT = {status: 1 << (len(TYPE_BIT) + i) for i, status in enumerate(GENDER_BY_LINE_STATUS)}
FAMILY_BITS = {
    family: sum(TYPE_BIT[part_type] for part_type in part_types)
    for family, part_types in FAMILY_PART_TYPES.items()
}

KEYS = ("Suplr_NPI", "year")
SUPPLIER_COLUMNS = (
    "Suplr_Prvdr_Last_Name_Org",
    "Suplr_Prvdr_State_Abrvtn",
    "Suplr_Prvdr_RUCA_Desc",
)
BENE_COLUMNS = tuple(f"{family}_Tot_Suplr_Benes" for family in FAMILY_BITS)
CLAIM_COLUMNS = tuple(f"{family}_Tot_Suplr_Clms" for family in FAMILY_BITS)
PAYMENT_COLUMNS = tuple(f"{family}_Suplr_Mdcr_Pymt_Amt" for family in FAMILY_BITS)
AGE_COLUMNS = tuple(f"Bene_Age_{band}_Cnt" for band, _ in AGE_BANDS)
GENDER_COLUMNS = tuple(f"Bene_{gender}_Cnt" for gender in GENDER_BY_LINE_STATUS.values())
RACE_COLUMNS = tuple(f"Bene_Race_{race}_Cnt" for race in RACE_BY_PART_TYPE.values())
PRIORITY_COLUMNS = tuple(f"Bene_CC_{name}_Pct" for name in CONDITION_BY_PRIORITY.values())
RETURN_COLUMNS = tuple(f"Bene_CC_{name}_Pct" for name in CONDITION_BY_RETURN_FLAG.values())
PANEL_COLUMNS = (
    KEYS
    + SUPPLIER_COLUMNS
    + BENE_COLUMNS
    + CLAIM_COLUMNS
    + PAYMENT_COLUMNS
    + AGE_COLUMNS
    + GENDER_COLUMNS
    + RACE_COLUMNS
    + PRIORITY_COLUMNS
    + RETURN_COLUMNS
)

Reader = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> Reader:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def order_panel(
    tables: Reader,
    columns: Iterable[str] = PANEL_COLUMNS,
    years: Sequence[int] | None = None,
    missing: Mapping[str, str] | None = None,
) -> DataFrame:
    """Derive the panel columns asked for; ``years`` limits the scan to ship dates in
    those years. ``missing`` maps a column to a condition on the keys under which it is
    NULL, as published files leave values out."""
    columns = set(columns)
    unknown = columns - set(PANEL_COLUMNS)
    if unknown:
        raise KeyError(f"no such panel column: {sorted(unknown)}")
    wanted = [c for c in PANEL_COLUMNS if c in KEYS or c in columns]

    def asked(*groups: Sequence[str]) -> bool:
        return any(c in group for group in groups for c in wanted)

    lines = _lines(tables("lineitem"), years)
    if asked(BENE_COLUMNS, CLAIM_COLUMNS, PAYMENT_COLUMNS, RACE_COLUMNS):
        parts = tables("part").selectExpr(
            "p_partkey AS l_partkey", f"{_case('p_type', TYPE_BIT)} AS type_bit"
        )
        lines = lines.join(parts, "l_partkey", "left")
    else:
        lines = lines.withColumn("type_bit", F.lit(0))
    rows = _line_measures(lines, wanted)
    if asked(CLAIM_COLUMNS):
        rows = _regroup(rows, ("l_orderkey", *KEYS))
        rows = rows.selectExpr("*", *_order_counts(wanted))
    if asked(BENE_COLUMNS, AGE_COLUMNS, GENDER_COLUMNS, RACE_COLUMNS, PRIORITY_COLUMNS):
        rows = rows.join(_orders(tables, asked(AGE_COLUMNS)), "l_orderkey", "left")
        rows = rows.selectExpr("*", *_priority_lines(wanted))
    if asked(BENE_COLUMNS, AGE_COLUMNS, GENDER_COLUMNS, RACE_COLUMNS):
        rows = _regroup(rows, ("o_custkey", *KEYS))
        rows = rows.selectExpr("*", *_customer_counts(wanted))
    panel = _regroup(rows, KEYS)
    if asked(SUPPLIER_COLUMNS):
        panel = panel.join(_suppliers(tables, wanted), "Suplr_NPI", "left")
    shown = _shown()
    for c, condition in (missing or {}).items():
        shown[c] = f"CASE WHEN {condition} THEN NULL ELSE {shown.get(c, c)} END"
    return panel.selectExpr(*[f"{shown.get(c, c)} AS {c}" for c in wanted])


def _case(column: str, values: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{value}' THEN {number}" for value, number in values.items())
    return f"CASE {column} {whens} ELSE 0 END"


def _has(bits: int) -> str:
    return f"(mask & {bits}) != 0"


def _only(wanted: Sequence[str], named: dict[str, str]) -> list[str]:
    """SQL for the wanted panel columns, as ``expression AS column``."""
    return [f"{sql} AS {name}" for name, sql in named.items() if name in wanted]


def _lines(lineitem: DataFrame, years: Sequence[int] | None) -> DataFrame:
    if years is not None:
        # A range per year on the stored column reaches the file statistics.
        ranges = [
            f"l_shipdate >= timestamp_ntz'{year}-01-01' AND l_shipdate < timestamp_ntz'{year + 1}-01-01'"
            for year in years
        ]
        lineitem = lineitem.where(" OR ".join(ranges) or "false")
    return lineitem.selectExpr(
        "l_orderkey",
        "l_partkey",
        "l_suppkey AS Suplr_NPI",
        "year(l_shipdate) AS year",
        # Cents times whole percent: an exact integer count of 1/10000 dollars.
        "cast(rint(l_extendedprice * 100) AS bigint)"
        " * (100L - cast(rint(l_discount * 100) AS bigint)) AS units",
        f"{_case('l_linestatus', STATUS_BIT)} AS status_bit",
        "l_returnflag",
    )


def _line_measures(lines: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """One row per line: the keys, the attribute mask, and what is to be summed. Counts
    carry the name of the panel column that they end up in."""
    hits = {
        f"Bene_CC_{name}_Pct": f"CASE WHEN l_returnflag = '{flag}' THEN 1L ELSE 0L END"
        for flag, name in CONDITION_BY_RETURN_FLAG.items()
    }
    payments = {}
    for (family, bits), name in zip(FAMILY_BITS.items(), PAYMENT_COLUMNS):
        if name in wanted:
            # Dollars and remainder are summed apart: integer sums are several times
            # faster than decimal ones, and this way far from overflow at any size.
            payments[f"{family}_dollars"] = f"CASE WHEN {_has(bits)} THEN units div 10000 END"
            payments[f"{family}_rest"] = f"CASE WHEN {_has(bits)} THEN units % 10000 END"
    masked = lines.selectExpr("*", "coalesce(type_bit, 0) | status_bit AS mask")
    return masked.selectExpr(
        "l_orderkey",
        *KEYS,
        "mask",
        "1L AS lines",
        *_only(wanted, hits),
        *_only(tuple(payments), payments),
    )


def _order_counts(wanted: Sequence[str]) -> list[str]:
    """On rows of one order, supplier and year: 1 per family that the order touches."""
    return _only(
        wanted,
        {
            f"{family}_Tot_Suplr_Clms": f"cast(l_orderkey IS NOT NULL AND {_has(bits)} AS bigint)"
            for family, bits in FAMILY_BITS.items()
        },
    )


def _priority_lines(wanted: Sequence[str]) -> list[str]:
    return _only(
        wanted,
        {
            f"Bene_CC_{name}_Pct": f"CASE WHEN o_orderpriority = '{priority}' THEN lines ELSE 0L END"
            for priority, name in CONDITION_BY_PRIORITY.items()
        },
    )


def _customer_counts(wanted: Sequence[str]) -> list[str]:
    """On rows of one customer, supplier and year: 1 per attribute that the customer's
    lines ever had."""
    tests = {f"{family}_Tot_Suplr_Benes": _has(bits) for family, bits in FAMILY_BITS.items()}
    tests |= {
        f"Bene_Age_{band}_Cnt": f"coalesce(age = {i}, false)"
        for i, (band, _) in enumerate(AGE_BANDS)
    }
    tests |= {
        f"Bene_{gender}_Cnt": _has(STATUS_BIT[status])
        for status, gender in GENDER_BY_LINE_STATUS.items()
    }
    tests |= {
        f"Bene_Race_{race}_Cnt": _has(TYPE_BIT[part_type])
        for part_type, race in RACE_BY_PART_TYPE.items()
    }
    return _only(
        wanted,
        {
            name: f"cast(o_custkey IS NOT NULL AND {test} AS bigint)"
            for name, test in tests.items()
        },
    )


def _orders(tables: Reader, with_age: bool) -> DataFrame:
    orders = tables("orders").selectExpr(
        "o_orderkey AS l_orderkey", "o_custkey", "o_orderpriority"
    )
    if not with_age:
        return orders
    bands = " ".join(
        f"WHEN c_acctbal < {limit} THEN {i}" if limit is not None else f"ELSE {i}"
        for i, (_, limit) in enumerate(AGE_BANDS)
    )
    customers = tables("customer").selectExpr(
        "c_custkey AS o_custkey", f"CASE WHEN c_acctbal IS NULL THEN NULL {bands} END AS age"
    )
    return orders.join(customers, "o_custkey", "left")


def _suppliers(tables: Reader, wanted: Sequence[str]) -> DataFrame:
    name, nation, region = SUPPLIER_COLUMNS
    suppliers = tables("supplier").selectExpr("s_suppkey AS Suplr_NPI", f"s_name AS {name}", "s_nationkey")
    if nation in wanted or region in wanted:
        nations = tables("nation").selectExpr(
            "n_nationkey AS s_nationkey", f"n_name AS {nation}", "n_regionkey AS r_regionkey"
        )
        suppliers = suppliers.join(nations, "s_nationkey", "left")
    if region in wanted:
        regions = tables("region").selectExpr("r_regionkey", f"r_name AS {region}")
        suppliers = suppliers.join(regions, "r_regionkey", "left")
    return suppliers.select("Suplr_NPI", *[c for c in SUPPLIER_COLUMNS if c in suppliers.columns])


def _regroup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge rows to the coarser key: masks are united, everything countable is summed."""
    merge = {"mask": "bit_or(mask)", "age": "max(age)"}
    measures = [
        F.expr(f"{merge.get(name, f'sum({name})')} AS {name}")
        for name in rows.columns
        if name not in (*keys, "l_orderkey", "o_custkey", "o_orderpriority")
    ]
    return rows.groupBy(*keys).agg(*measures)


def _shown() -> dict[str, str]:
    """Panel columns that are more than their sum: payments and percentages."""
    shown = {}
    for family, c in zip(FAMILY_BITS, PAYMENT_COLUMNS):
        shown[c] = (
            f"cast(cast({family}_dollars AS decimal(24,4))"
            f" + cast({family}_rest AS decimal(24,4)) / 10000 AS decimal(28,4))"
        )
    for c in (*PRIORITY_COLUMNS, *RETURN_COLUMNS):
        # Whole hundredths of a percent, as an exact decimal.
        hundredths = f"cast(floor(cast(10000 AS double) * {c} / lines) AS bigint)"
        shown[c] = f"cast({hundredths} AS decimal(9,2)) * cast(0.01 AS decimal(3,2))"
    return shown
