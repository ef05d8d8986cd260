"""Operators on random data against plain Python that goes step by step."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import approvals, checks, dedup, lineage, reconcile, risk

ACTIONS = ["approval_requested", "approval_granted", "approval_rejected", "agent_invoked"]
STATES = ["PASSED", "BLOCKED", "REJECTED", None]


def fold(events):
    """The approval file of one incident after its events, one after the other."""
    state, by, blocked, open_, passed = "NOT_REQUESTED", None, 0, False, False
    for action, status, actor in events:
        is_attempt = action == "approval_rejected" and status == "BLOCKED"
        if is_attempt:
            blocked += 1
        elif action == "approval_requested":
            open_, passed = True, status == "PASSED"
            if state != "APPROVED":
                state, by = "PENDING", None
        elif action == "approval_granted" and open_:
            if not passed or status == "BLOCKED":
                blocked += 1
            elif state != "APPROVED":
                state, by = "APPROVED", actor
        elif action == "approval_rejected" and status is not None and open_:
            open_ = False
            if state != "APPROVED":
                state, by = "REJECTED", actor
    return state, by, blocked


@pytest.mark.parametrize("seed", [1, 2])
def test_approval_fold(spark, seed):
    rng = random.Random(seed)
    log = [(i, rng.randrange(60), rng.choice(ACTIONS), rng.choice(STATES), f"a{rng.randrange(5)}",
            rng.randrange(400)) for i in range(1500)]
    passed = {k: rng.choice([True, False, None]) for k in range(50)}
    events = spark.createDataFrame(
        log, "event_id int, incident_key int, action string, status string, actor string, m int"
    ).withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    verified = spark.createDataFrame(list(passed.items()),
                                     "incident_key int, verification_passed boolean")
    out = approvals.approval_state(events, verified)
    got = {r.incident_key: (r.approval_status, r.approved_by, r.blocked_attempts)
           for r in out.collect()}
    per = defaultdict(list)
    for i, k, action, status, actor, m in sorted(log, key=lambda e: (e[5], e[0])):
        per[k].append((action, status, actor))
    want = {k: fold(v) for k, v in per.items()
            if any(a != "agent_invoked" for a, _, _ in v)}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_reach(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)]
    begin = sorted({rng.randrange(30) for _ in range(6)})
    reached = lineage.reach(spark.createDataFrame(edges, "src int, dst int"),
                            spark.createDataFrame([(s,) for s in begin], "start int"))
    want = set()
    for s in begin:
        depth, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for a, b in edges:
                if a == n and b not in depth:
                    depth[b] = depth[n] + 1
                    queue.append(b)
        want |= {(s, n, d) for n, d in depth.items()}
    got = [tuple(r) for r in reached.select("start", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_diff(spark, seed):
    rng = random.Random(seed)

    def side():
        return [(rng.choice([*range(12), None]), rng.choice(["x", "y", None]), rng.randrange(2))
                for _ in range(25)]
    before, after = side(), side()
    schema = "k int, v string, w int"
    got = {r.k: (r.n_before, r.n_after, r.change, r.changed_columns) for r in reconcile.keyed_diff(
        spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["k"]).collect()}
    want = {}
    for key in {r[0] for r in [*before, *after]}:
        b, a = ([r[1:] for r in t if r[0] == key] for t in (before, after))
        if sorted(map(str, b)) == sorted(map(str, a)):
            continue
        net = defaultdict(int)
        for r in a:
            net[r] += 1
        for r in b:
            net[r] -= 1
        moved = []
        for i, name in enumerate(("v", "w")):
            cell = defaultdict(int)
            for r, n in net.items():
                cell[r[i]] += n
            if max(cell.values()) > 0 > min(cell.values()):
                moved.append(name)
        change = ("added" if not b else "removed" if not a else "changed" if moved else "repeated")
        want[key] = (len(b), len(a), change, moved if change == "changed" else [])
    assert got == want


def test_latest_late_and_rank(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([1, 2, 3, None]), rng.randrange(40), rng.choice([None, rng.randrange(9)]),
             rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(data, "strategy_key int, incident_key int, s int, risk_score bigint, "
                               "scope_size bigint")
    latest = {r.incident_key: (r.s, r.strategy_key) for r in dedup.latest_by_key(
        df, ["incident_key"], ["s"], [F.asc("strategy_key")]).collect()}
    assert latest == {k: min(((r[2], r[0]) for r in data if r[1] == k), key=lambda x: (-x[0], x[1]))
                      for k in (1, 2, 3)}

    times = df.withColumn("t", F.timestamp_seconds("s"))
    late = checks.late_rows(times, ["incident_key"], ["strategy_key"], "t",
                            "5 seconds")
    seen, want = {}, set()
    for i, k, s, *_ in data:
        if k in seen and s < seen[k] - 5:
            want.add(i)
        seen[k] = max(s, seen.get(k, s))
    assert {r.strategy_key for r in late.filter("late").collect()} == want

    place = {r.strategy_key: r.strategy_rank for r in risk.rank(df).collect()}
    for k in (1, 2, 3, None):
        mine = sorted((r for r in data if r[1] == k),
                      key=lambda r: (r[3] is None, r[3] or 0, r[4], r[0]))
        assert [place[r[0]] for r in mine] == list(range(1, len(mine) + 1))
