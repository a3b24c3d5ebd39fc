"""Every registered query of the engine's own operators runs at sf0.001, and equals its SQL where it has one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanlab.functions import text
from spanlab.plans import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert_same(df, SF, registry.ORACLE_SQL[name])
    else:
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_jn7_whole_joins_every_residue(spark):
    rows = registry.QUERIES["jn7_knn_band_join_whole"](spark, SF).collect()
    assert {r["b_id"] % 4 for r in rows} == {1, 2, 3} and {r["a_id"] % 4 for r in rows} == {0}


def test_jn8_turns_match_brute_force(spark):
    """Every turn's whole text against every item, by edit ratio and then wording."""
    said = lambda name, *cols: spark.read.parquet(f"{SF}/{name}.parquet").select(*cols, text.norm_spoken(F.col("text")).alias("n"))
    refs = sorted({r["n"] for r in said("benchmark").collect()})

    def ratio(a, b):
        """Edit distance by whole rows of the table: a row's inserts are a running minimum."""
        y, at = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
        row = at.copy()
        for i, x in enumerate(a, 1):
            new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != ord(x)))])
            row = np.minimum.accumulate(new - at) + at
        return int(row[-1]) / max(len(a), len(b), 1)

    got = {(r["conv_id"], r["turn"]): r for r in registry.QUERIES["jn8_nearest_reference_turns"](spark, SF).collect()}
    turns = said("conversations", "conv_id", "turn").collect()
    assert len(got) == len({(r["conv_id"], r["turn"]) for r in turns}) and max(len(r["n"]) for r in turns) > 60
    known = {}
    for r in turns:
        if r["n"] not in known:
            known[r["n"]] = min((ratio(r["n"], x), x) for x in refs)
        best, ref = known[r["n"]]
        hit = got[r["conv_id"], r["turn"]]
        assert hit["nearest"] == ref and abs(hit["ratio"] - best) < 1e-12
