import re

import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"([a-hkt]|op)\d+_[a-z0-9_]+|pipeline", n) for n in names)


def test_every_family_is_covered():
    have = {n.split("_")[0] for n in entry.queries()}
    sizes = {"a": 11, "b": 20, "c": 11, "d": 44, "e": 22, "f": 30, "g": 13, "h": 13, "k": 24, "t": 3}
    assert [f"{f}{i}" for f, n in sizes.items() for i in range(1, n + 1) if f"{f}{i}" not in have] == []


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "median" in out.columns
