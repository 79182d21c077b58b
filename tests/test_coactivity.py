import datetime as dt
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from threadloom.operators import coactivity as A
from threadloom.plans import models
from threadloom.plans.corpus import QUERIES, active_users


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events, and the keys of each user: hours since the first event, to the microsecond."""
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1, 0, 0, 7, 900_000)
    rows = [(start, 0, "view"), (start + dt.timedelta(seconds=3599, microseconds=600_000), 1, "view"), (start, 2, "view")]  # 1 is within the first hour
    rows += [(start + dt.timedelta(seconds=float(rng.integers(0, 20 * 3600))), int(u), str(rng.choice(["view", "click"]))) for u in rng.integers(-9, 31, 400)]
    keys: dict[int, set] = {}
    for t, u, kind in rows:
        keys.setdefault(u, set()).add((kind, (t - start) // dt.timedelta(hours=1)))
    rows += [(start, None, "view"), (start, 3, None), (None, 4, "view"), rows[0]]
    where = tmp_path_factory.mktemp("co")
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string").write.parquet(f"{where}/events.parquet")
    return str(where), keys


def pairs(keys):
    return {(a, b): n for a, b in combinations(sorted(keys), 2) if (n := len(keys[a] & keys[b]))}


def test_co_activity_edges_without_a_table_of_pairs(spark, events):
    where, keys = events
    made = QUERIES["co_activity_edges"](spark, where)
    assert {(r["src"], r["dst"]): r["observations"] for r in made.collect()} == pairs(keys)
    assert all(r["weight"] == round(0.6 * np.log(1 + r["observations"]), 5) for r in made.collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    for block in (150, 100_000):  # users with few and with many of the others in common
        assert sorted(A.pair_edges(active_users(spark, where), block).collect()) == sorted(made.collect())
    assert A.pair_edges(active_users(spark, where).where("false")).collect() == []



def test_modularity_from_sums_by_user(spark, events):
    where, keys = events
    weights = {p: round(0.6 * np.log(1 + n), 5) for p, n in pairs(keys).items()}
    kind, m = lambda u: int(np.fmod(u, 5)), sum(weights.values())
    deg = Counter()
    for (a, b), w in weights.items():
        deg[kind(a)] += w
        deg[kind(b)] += w
    want = sum(w for (a, b), w in weights.items() if kind(a) == kind(b)) / m - sum(d * d for d in deg.values()) / (4 * m * m)
    assert QUERIES["modularity"](spark, where).first()["modularity"] == pytest.approx(want, abs=1e-6)
    whole = sorted(A.node_sums(active_users(spark, where), 5).collect())
    for block in (150,):
        parts = sorted(A.node_sums(active_users(spark, where), 5, block).collect())
        assert np.allclose([list(r) for r in parts], [list(r) for r in whole])


def test_communities_and_scores_of_two_groups(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=h), u, "view") for g in (0, 10) for u in range(g, g + 4) for h in range(g, g + 3)]
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    made = {r["node"]: (r["community"], r["score"]) for r in models.QUERIES["coordination"](spark, str(tmp_path)).collect()}
    assert made == {u: (g, 1.0) for g in (0, 10) for u in range(g, g + 4)}
