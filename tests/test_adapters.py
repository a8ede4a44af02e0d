"""Domain views over the star tables: how their joins are planned."""

import pytest

from voxrill.plans import adapters as A


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE"), (2, None)]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1), (1, 0), (2, 2), (3, None)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1), (3, 2), (4, 3), (4, 0), (None, 0)]),
        "part": ("p_partkey long, p_brand string", [(1, "Brand#3"), (10, "Brand#25"), (None, "Brand#1")]),
        "lineitem": (
            "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
            [(p, s, 1, 5.0, 1000.0, 0.0, 0.01, "N", "F") for p in (1, 10, None) for s in (1, 2, 3, 4, None)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_small_tables_are_broadcast_one_by_one(spark, star):
    plan = A.phones(spark, star)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4


def test_phones_have_the_rows_of_the_joined_speakers(spark, star):
    got = sorted((r["recording_id"], r["language"] or "", r["lang"], r["sex"], r["phoneme"]) for r in A.phones(spark, star).collect())
    said = {1: [("zh-CN", "zh")], 2: [("fr-FR", "fr"), ("zh-CN", "zh")], 4: [("zh-CN", "zh")]}
    told = {r["speaker_id"]: [] for r in A.speakers(spark, star).collect()}
    for r in A.speakers(spark, star).collect():
        told[r["speaker_id"]].append((r["language"], r["lang"]))
    assert {k: sorted(v) for k, v in told.items() if k in said} == said
    want = [(s * 10 + 1, t or "", g, "F" if s % 2 == 0 else "M", ph) for s, v in told.items() if s for t, g in v for ph in (A.LABELS[2], A.LABELS[24])]
    assert got == sorted(want)
