import random

from tracewarden.operators import policy

SEVERITIES = ["info", "low", "medium", "high", "critical", "odd", None, ""]
EVENTS = ("seq int, tenant_id string, sensor_id string, server_name string, method string, "
          "findings array<struct<rule_id:string,category:string,severity:string>>")


def _some(rng, values, chance):
    return [rng.choice(values) for _ in range(rng.randrange(0, 3))] if rng.random() < chance else None


def _policies(rng, n):
    def one(i):
        return {"id": f"p{i}", "mode": rng.choice(["monitor", "warn", "block", "odd"]), "enabled": rng.random() < 0.9,
                "tenant_id": rng.choice([None, "", "t1", "t2"]), "sensor_id": rng.choice([None, "", "s1"]), "server_name": rng.choice([None, "v1"]),
                "rule_ids": _some(rng, ["r1", "r2", None], 0.4), "categories": _some(rng, ["c1", "c2", None], 0.4),
                "min_severity": rng.choice([None, None, *SEVERITIES]), "methods": _some(rng, ["m1", "m2"], 0.4)}
    return [one(i) for i in range(n)]


def _events(rng, n):
    return [(i, rng.choice(["t1", "t2", "", None]), rng.choice(["s1", "", None]), rng.choice(["v1", "", None]), rng.choice(["m1", "m2", "", None]),
             rng.choice([None, [], [(rng.choice(["r1", "r2", "r3", None]), rng.choice(["c1", "c2", None]), rng.choice(SEVERITIES)) for _ in range(rng.randrange(1, 4))]]))
            for i in range(n)]


def _answers(df):
    return sorted((r.seq, r.mode, r.matched_policy and r.matched_policy.id) for r in df.collect())


def test_index_and_walk_resolve_alike(spark):
    """Random lists with nulls, empty selectors and unknown words; repeated events; few policies so that each decides something."""
    for seed in range(4):
        rng = random.Random(seed)
        pols = policy.policies_table(spark, _policies(rng, (6, 40, 40, 200)[seed]))
        rows = _events(rng, 150)
        events = spark.createDataFrame(rows + rows[:30], EVENTS)
        walked, indexed = (_answers(policy.resolve_policy(events, pols, "none", plan_policies=n)) for n in (10_000, 0))
        assert walked == indexed and len(indexed) == 180
    none = policy.policies_table(spark, [])
    assert {a[1:] for a in _answers(policy.resolve_policy(events, none, "none", plan_policies=-1))} == {("none", None)}


def test_a_hundred_thousand_policies_in_one_scope(spark):
    many = spark.range(100_000).selectExpr(
        "concat('p', id) id", "'n' name", "1L version", "true enabled", "'t' tenant_id", "'' sensor_id", "'' server_name", "array(concat('r', id)) rule_ids",
        "CAST(NULL AS array<string>) categories", "IF(id % 2 = 0, 'high', '') min_severity", "CAST(NULL AS array<string>) methods",
        "IF(id % 3 = 0, 'block', 'warn') mode", "CAST(id AS int) pos")
    rows = [(i, "t", "", "", "m", [(f"r{i * 11}", "c", "high" if i % 4 else "low"), (f"r{i * 11 + 1}", "c", "low")]) for i in range(300)]
    out = policy.resolve_policy(spark.createDataFrame(rows, EVENTS), many, "none")
    want = []
    for i in range(300):
        live = [p for p, sev in ((i * 11, 3 if i % 4 else 1), (i * 11 + 1, 1)) if p % 2 or sev >= 3]
        best = max(live, key=lambda p: (2 if p % 3 == 0 else 1, p), default=None)
        want.append((i, "none" if best is None else "block" if best % 3 == 0 else "warn", best if best is None else f"p{best}"))
    assert _answers(out) == want
    assert "p99999" not in out._jdf.queryExecution().executedPlan().toString()
