"""The derived panel against brute force, on tables with hot keys and broken links."""

import random

import pytest
from conftest import rows

from catalogue import order_panel as op

TYPES = [*op.TYPE_BIT, "OTHER", None]


@pytest.fixture(scope="module")
def data():
    """A third of all lines belong to one order, one customer and one supplier."""
    rnd = random.Random(7)
    parts = [(i, rnd.choice(TYPES)) for i in range(20)]
    customers = [(i, rnd.choice([1699.99, 1700.0, 4300.0, 7350.0, None])) for i in range(60)]
    orders = [
        (i, rnd.choice([None, *range(60), 999]), rnd.choice([*op.CONDITION_BY_PRIORITY, "5-LOW"]))
        for i in range(150)
    ]
    orders[0] = (0, 3, "1-URGENT")
    lines = []
    for i in range(1500):
        hot = i % 3 == 0
        lines.append(
            (
                0 if hot else rnd.choice([None, *range(1, 170)]),
                rnd.choice([None, *range(22)]),
                1 if hot else rnd.choice([None, 1, 2, 3]),
                round(rnd.uniform(1, 90000), 2),
                rnd.randrange(0, 11) / 100,
                rnd.choice("RAN"),
                rnd.choice("FOX"),
                f"{rnd.choice([2000, 2001])}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}",
            )
        )
    return {"part": parts, "customer": customers, "orders": orders, "lineitem": lines}


SCHEMAS = {
    "part": "p_partkey bigint, p_type string",
    "customer": "c_custkey bigint, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double,"
    " l_discount double, l_returnflag string, l_linestatus string, l_shipdate string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


@pytest.fixture
def tables(spark, data):
    small = {
        "supplier": [(1, "One", 1), (2, "Two", 2)],
        "nation": [(1, "N1", 1), (2, "N2", 9)],
        "region": [(1, "R1")],
    }
    frames = {n: spark.createDataFrame(v, SCHEMAS[n]) for n, v in (data | small).items()}
    frames["lineitem"] = frames["lineitem"].withColumn(
        "l_shipdate", frames["lineitem"]["l_shipdate"].cast("timestamp_ntz")
    )
    return frames.__getitem__


def brute_force(data):
    types = dict(data["part"])
    balance = dict(data["customer"])
    orders = {o: (c, p) for o, c, p in data["orders"]}
    names = {1: ("One", "N1", "R1"), 2: ("Two", "N2", None)}
    groups = {}
    for line in data["lineitem"]:
        groups.setdefault((line[2], int(line[7][:4])), []).append(line)
    out = {}
    for (supplier, year), lines in groups.items():
        row = dict.fromkeys(op.PANEL_COLUMNS)
        row["Suplr_NPI"], row["year"] = supplier, year
        for c, v in zip(op.SUPPLIER_COLUMNS, names.get(supplier, (None,) * 3)):
            row[c] = v

        def customers(test):
            found = {orders.get(ln[0], (None, None))[0] for ln in lines if test(ln)}
            return len(found - {None})

        def percent(test):
            hundredths = 10000 * sum(map(test, lines)) // len(lines)
            return hundredths / 100

        for family, kinds in op.FAMILY_PART_TYPES.items():
            mine = [ln for ln in lines if types.get(ln[1]) in kinds]
            benes = customers(lambda ln: ln in mine)
            row[f"{family}_Tot_Suplr_Benes"] = benes
            row[f"{family}_Tot_Suplr_Clms"] = len({ln[0] for ln in mine} - {None})
            units = [round(ln[3] * 100) * (100 - round(ln[4] * 100)) for ln in mine]
            row[f"{family}_Suplr_Mdcr_Pymt_Amt"] = sum(units) / 10000 if units else None
        for kind, race in op.RACE_BY_PART_TYPE.items():
            row[f"Bene_Race_{race}_Cnt"] = customers(lambda ln: types.get(ln[1]) == kind)
        for status, gender in op.GENDER_BY_LINE_STATUS.items():
            row[f"Bene_{gender}_Cnt"] = customers(lambda ln: ln[6] == status)
        low = float("-inf")
        for band, limit in op.AGE_BANDS:
            high = float("inf") if limit is None else limit

            def in_band(ln, low=low, high=high):
                money = balance.get(orders.get(ln[0], (None, None))[0])
                return money is not None and low <= money < high

            row[f"Bene_Age_{band}_Cnt"] = customers(in_band)
            low = high
        for priority, name in op.CONDITION_BY_PRIORITY.items():
            row[f"Bene_CC_{name}_Pct"] = percent(
                lambda ln: orders.get(ln[0], (None, None))[1] == priority
            )
        for flag, name in op.CONDITION_BY_RETURN_FLAG.items():
            row[f"Bene_CC_{name}_Pct"] = percent(lambda ln: ln[5] == flag)
        out[supplier, year] = row
    return out


def collected(df):
    return {
        (r["Suplr_NPI"], r["year"]): {
            c: float(v) if c.endswith(("_Amt", "_Pct")) and v is not None else v
            for c, v in r.asDict().items()
        }
        for r in df.collect()
    }


def test_full_panel(tables, data):
    assert collected(op.order_panel(tables)) == brute_force(data)


def test_full_panel_without_broadcast(tables, data, no_broadcast):
    assert collected(op.order_panel(tables)) == brute_force(data)


@pytest.mark.parametrize("column", op.PANEL_COLUMNS[2:])
def test_each_column_alone(tables, data, column):
    expected = {
        key: {c: row[c] for c in ("Suplr_NPI", "year", column)}
        for key, row in brute_force(data).items()
    }
    assert collected(op.order_panel(tables, [column])) == expected


def test_years(tables, data):
    expected = {k: row for k, row in brute_force(data).items() if k[1] == 2001}
    assert collected(op.order_panel(tables, years=[2001])) == expected
    assert rows(op.order_panel(tables, years=[])) == []


def test_missing_values_by_rule(tables, data):
    expected = brute_force(data)
    for (supplier, _), row in expected.items():
        if supplier == 1:
            row["DME_Tot_Suplr_Benes"] = None
    out = op.order_panel(tables, missing={"DME_Tot_Suplr_Benes": "Suplr_NPI = 1"})
    assert collected(out) == expected


def test_unknown_column(tables):
    with pytest.raises(KeyError):
        op.order_panel(tables, ["nope"])


def test_payments_beyond_64_bits_of_ten_thousandths(spark, tables):
    """Totals that an integer count of 1/10000 dollars could not hold."""
    price = 9.0e13
    lines = [(1, 1, 1, price, 0.0, "R", "F", "2000-01-01")] * 40
    frame = spark.createDataFrame(lines, SCHEMAS["lineitem"])
    frame = frame.withColumn("l_shipdate", frame["l_shipdate"].cast("timestamp_ntz"))
    part = spark.createDataFrame([(1, "MEDIUM")], SCHEMAS["part"])
    swapped = {"lineitem": frame, "part": part}
    panel = op.order_panel(lambda n: swapped.get(n) or tables(n))
    assert float(panel.collect()[0]["DME_Suplr_Mdcr_Pymt_Amt"]) == 40 * price
