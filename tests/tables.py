"""A small star of hand-made rows in a folder, as the queries read it."""

from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq

TYPES = {
    "region": {"r_regionkey": pa.int32(), "r_name": pa.string()},
    "nation": {"n_nationkey": pa.int32(), "n_name": pa.string(), "n_regionkey": pa.int32()},
    "customer": {"c_custkey": pa.int64(), "c_name": pa.string(), "c_nationkey": pa.int32(), "c_acctbal": pa.float64(), "c_mktsegment": pa.string()},
    "supplier": {"s_suppkey": pa.int64(), "s_name": pa.string(), "s_nationkey": pa.int32(), "s_acctbal": pa.float64()},
    "part": {"p_partkey": pa.int64(), "p_name": pa.string(), "p_brand": pa.string(), "p_type": pa.string(), "p_size": pa.int32(), "p_retailprice": pa.float64()},
    "orders": {"o_orderkey": pa.int64(), "o_custkey": pa.int64(), "o_orderstatus": pa.string(), "o_totalprice": pa.float64(), "o_orderdate": pa.timestamp("us"), "o_orderpriority": pa.string()},
    "lineitem": {
        "l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_linenumber": pa.int32(), "l_quantity": pa.float64(), "l_extendedprice": pa.float64(),
        "l_discount": pa.float64(), "l_tax": pa.float64(), "l_returnflag": pa.string(), "l_linestatus": pa.string(), "l_shipdate": pa.timestamp("us"),
    },
    "events": {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()},
}


def write(folder, **tables) -> str:
    """``tables``: rows as dictionaries; columns left out are null. Tables left out are empty."""
    os.makedirs(folder, exist_ok=True)
    for name, types in TYPES.items():
        rows = [{c: row.get(c) for c in types} for row in tables.get(name, [])]
        pq.write_table(pa.Table.from_pylist(rows, pa.schema(list(types.items()))), f"{folder}/{name}.parquet")
    return str(folder)


def star(folder, rng, orders=60, parts=12, customers=15) -> str:
    """Receipts of one to four lines over 2024, with parts of several brands and types, in two regions."""
    return write(
        folder,
        region=[{"r_regionkey": k, "r_name": f"R{k}"} for k in range(2)],
        nation=[{"n_nationkey": k, "n_name": f"N{k}", "n_regionkey": k} for k in range(2)],
        customer=[{"c_custkey": k, "c_name": f"c{k}", "c_nationkey": k % 2, "c_acctbal": 1.0, "c_mktsegment": "S"} for k in range(customers)],
        supplier=[{"s_suppkey": k, "s_name": f"s{k}", "s_nationkey": k % 2, "s_acctbal": 1.0} for k in range(4)],
        part=[{"p_partkey": k, "p_name": f"red {'bolt gear nut'.split()[k % 3]}", "p_brand": f"Brand#{k % 5 * 7 + 1}", "p_type": "AB"[k % 2], "p_size": k, "p_retailprice": 10.0 + k} for k in range(parts)],
        orders=[{"o_orderkey": k, "o_custkey": rng.randrange(customers), "o_totalprice": 1.0, "o_orderdate": dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(300)), "o_orderpriority": "1"} for k in range(orders)],
        lineitem=[
            {"l_orderkey": k, "l_partkey": rng.randrange(parts), "l_suppkey": rng.randrange(4), "l_linenumber": n, "l_quantity": float(rng.randrange(1, 5)), "l_extendedprice": float(rng.randrange(100, 900)),
             "l_discount": rng.randrange(5) / 100, "l_tax": 0.0, "l_returnflag": rng.choice("NAR")}
            for k in range(orders) for n in range(rng.randrange(1, 5))
        ],
    )
