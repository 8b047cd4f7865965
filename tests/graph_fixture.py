"""A dozen hand-made rows with everything the given tables lack."""

import datetime as dt

from remitgraph.plans.tables import SCHEMAS, GraphTables

P, C = "Partnership #2370", "Corporation #24457"


def at(day):
    return dt.datetime(2022, 9, day, 14, 6)


def hand_made(spark) -> GraphTables:
    entities = [("800CD3AC0", P), ("8006ABC00", C), ("E3", "Shared Owner"), ("E4", P), ("E5", "Silent"), ("E6", None)]
    owned = [("800CD3AC0", "1|p"), ("8006ABC00", "2|c"), ("800CD3AC0", "1|joint"), ("E3", "1|joint"),
             ("E4", "3|q"), ("E5", "4|s"), ("E3", "5|nobank")]
    held = [("1|p", 1), ("2|c", 2), ("1|joint", 1), ("3|q", 3), ("4|s", 4)]

    def tx(i, when, sender, receiver, paid, currency="Euro", label=True):
        return (i, when, sender, receiver, paid, currency, paid, currency, "Cheque", label, "Transaction")

    transactions = [
        tx("t01", at(3), "1|p", "2|c", 101.5),
        tx("t02", None, "2|c", "1|p", 12345678.9, label=False),
        tx("t03", at(3), "2|c", "1|joint", 3.0, "Yen"),
        tx("t04", at(1), "1|joint", "1|joint", 4.0),  # two owners: a path only between different ones
        tx("t05", at(2), "1|p", "1|p", 5.0),          # one owner: no path
        tx("t06", at(2), "1|p", "3|q", 6.0),          # between two entities of one name
        tx("t07", at(4), "4|s", "2|c", None),
        tx("t08", at(4), "1|p", "5|nobank", 8.0),     # the receiver has no bank
        tx("t09", at(5), "9|unknown", "2|c", 9.0),
        tx("t10", at(5), "1|p", "1|joint", 10.0),     # between two accounts of one owner
        tx("t11", at(6), "2|c", "2|c", 11.0, label=None),
    ]
    banks = [(1, "Bank 1", "Bank"), (2, None, "Bank"), (3, "Bank 3", "Bank"), (4, "Bank 4", "Bank")]
    make = lambda name, data: spark.createDataFrame(data, SCHEMAS[name])
    keys = sorted({k for _, k in owned})
    return GraphTables(
        accounts=make("accounts", [(k, k, None, None, None, None, "Account") for k in keys]),
        banks=make("banks", banks),
        entities=make("entities", [(*e, "Entity") for e in entities]),
        transactions=make("transactions", transactions),
        owns=make("owns", owned),
        held_at=make("held_at", held),
        sent=make("sent", [(t[2], t[0]) for t in transactions]),
        received_by=make("received_by", [(t[0], t[3]) for t in transactions]),
    )
