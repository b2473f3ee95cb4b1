import json

from pyspark.sql import functions as F

from veilframe.operators import policy

RULES = "policy_id string, pos bigint, entity_type string, action string, roles array<string>, classification string"


def decide(spark, document, entities, agent_id=None, agent_role=None):
    policies = spark.createDataFrame([("p", json.dumps(document))], "policy_id string, document string")
    rows = spark.createDataFrame(
        [("p", e, agent_id, agent_role) for e in entities],
        "policy_id string, entity_type string, agent_id string, agent_role string",
    )
    out = policy.evaluate(rows, policy.rules_of(policies), policy.exceptions_of(policies), policy.packs_of(policies))
    return {r.entity_type: r for r in out.collect()}


def test_defaults(spark):
    got = decide(spark, {}, ["SSN", "EMAIL", "DATE", "IP_ADDRESS", "BADGE"])
    assert {k: r.action for k, r in got.items()} == {
        "SSN": "REDACT", "EMAIL": "TOKENIZE", "DATE": "PASS", "IP_ADDRESS": "MASK", "BADGE": "REDACT",
    }
    assert "Default deny" in got["BADGE"].reason and got["SSN"].reason == "Default policy"


def test_roles_and_last_rule(spark):
    document = {
        "rules": [
            {"entity_type": "SSN", "action": "redact", "roles": ["analyst", "viewer"]},
            {"entity_type": "SSN", "action": "PASS", "roles": ["admin"]},
            {"entity_type": "EMAIL"},
            {"action": "PASS"},
        ]
    }
    assert decide(spark, document, ["SSN"], agent_role="admin")["SSN"].action == "PASS"
    assert decide(spark, document, ["SSN"], agent_role="analyst")["SSN"].action == "REDACT"
    assert decide(spark, document, ["SSN"])["SSN"].action == "PASS"  # without a role every rule matches
    other = decide(spark, document, ["SSN", "EMAIL"], agent_role="auditor")
    assert (other["SSN"].reason, other["EMAIL"].action) == ("Default policy", "REDACT")


def test_exceptions(spark):
    document = {
        "rules": [{"entity_type": "SSN", "action": "REDACT"}],
        "exceptions": [
            {"agent_id": "agent-audit-08", "entity_types": ["SSN", "EMAIL"]},
            {"agent_role": "auditor", "entity_types": ["SSN"], "action": "mask"},
        ],
    }
    got = decide(spark, document, ["SSN", "EMAIL", "PHONE"], agent_id="agent-audit-08")
    assert [got[e].action for e in ("SSN", "EMAIL", "PHONE")] == ["PASS", "PASS", "TOKENIZE"]
    assert got["SSN"].overridden_by == "exception:agent-audit-08" and got["PHONE"].overridden_by is None
    both = decide(spark, document, ["SSN"], agent_id="agent-audit-08", agent_role="auditor")["SSN"]
    assert both.action == "MASK"  # the later exception counts
    assert decide(spark, document, ["SSN"], agent_id="else")["SSN"].action == "REDACT"


def test_compliance_refs(spark):
    got = decide(spark, {"compliance_packs": ["PCI-DSS", "GDPR", "NONE"]}, ["EMAIL", "SSN", "BADGE"])
    assert got["EMAIL"].compliance_refs == ["PCI-DSS: TOKENIZE required", "GDPR: PSEUDONYMIZE required"]
    assert got["SSN"].compliance_refs == ["PCI-DSS: TOKENIZE required", "GDPR: REDACT required"]
    assert got["BADGE"].compliance_refs == []
    assert decide(spark, {"compliance_packs": "HIPAA"}, ["EMAIL"])["EMAIL"].compliance_refs == []


def test_rows_are_never_multiplied(spark):
    rules = [("p", i, "SSN", "REDACT" if i % 2 else "MASK", None, None) for i in range(500)]
    rows = spark.createDataFrame([("p", "SSN")] * 20, "policy_id string, entity_type string")
    got = policy.evaluate(rows, spark.createDataFrame(rules, RULES)).collect()
    assert len(got) == 20 and {r.action for r in got} == {"REDACT"}


def test_conflicts(spark):
    three = [("p", i, "SSN", a, None, None) for i, a in enumerate(["REDACT", "MASK", "PASS"])]
    apart = [("q", 0, "SSN", "REDACT", ["a"], None), ("q", 1, "SSN", "PASS", ["b"], None)]
    meet = [("r", 0, "SSN", "REDACT", ["a", "c"], None), ("r", 1, "SSN", "PASS", ["c", "b"], None)]
    got = policy.conflicts(spark.createDataFrame(three + apart + meet, RULES)).collect()
    assert sorted(r.policy_id for r in got) == ["p", "p", "p", "r"]
    assert [r.description for r in got if r.policy_id == "r"] == [
        "SSN: conflicting actions REDACT vs PASS for overlapping roles c"
    ]


def test_repeated_rules_are_one_conflict(spark):
    rules = [("p", i, "SSN", "REDACT" if i % 2 else "MASK", None, None) for i in range(1000)]
    got = policy.conflicts(spark.createDataFrame(rules, RULES)).collect()
    assert [(r.pos_a, r.pos_b, r.rule_pairs) for r in got] == [(0, 1, 250_000)]


def test_most_restrictive(spark):
    pairs = [("PASS", "REDACT", "REDACT"), ("MASK", "GENERALIZE", "MASK"), ("odd", "PSEUDONYMIZE", "odd"), ("ENCRYPT", "odd", "ENCRYPT")]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert df.where(policy.most_restrictive(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_validate(spark):
    documents = [
        ("good", '{"rules": [{"entity_type": "SSN", "action": "REDACT", "roles": null}]}'),
        ("none", "{}"),
        ("text", '"rules"'),
        ("clash", '{"rules": [{"entity_type": "SSN", "action": "REDACT"}, {"entity_type": "SSN", "action": "PASS"}]}'),
    ]
    got = {r.policy_id: r for r in policy.validate(spark.createDataFrame(documents, "policy_id string, document string")).collect()}
    assert got["good"].valid and got["good"].warnings == []
    assert got["none"].valid and got["none"].warnings[0].startswith("No 'rules' key")
    assert got["text"].errors == ["Root element must be a mapping"]
    assert got["clash"].warnings == ["Conflict: SSN: conflicting actions REDACT vs PASS"]


def test_diff(spark):
    old = [("p", 0, "SSN", "REDACT", None, None), ("p", 1, "EMAIL", "MASK", None, None), ("p", 2, "PHONE", "PASS", None, "PUBLIC")]
    new = [("p", 0, "SSN", "REDACT", ["a"], None), ("p", 1, "IBAN", "MASK", None, None), ("p", 2, "PHONE", "MASK", None, None)]
    got = policy.diff(spark.createDataFrame(old, RULES), spark.createDataFrame(new, RULES)).collect()
    assert sorted((r.entity_type, r.field, r.change_type) for r in got) == [
        ("EMAIL", "rule", "REMOVED"), ("IBAN", "rule", "ADDED"), ("PHONE", "action", "MODIFIED"),
        ("PHONE", "classification", "MODIFIED"), ("SSN", "roles", "MODIFIED"),
    ]


def test_packs(spark):
    names = spark.createDataFrame([("eu ai-act",), ("Gdpr",), ("x",)], "pack string")
    assert policy.pack_rules(names).groupBy("pack").count().count() == 2
    types = spark.createDataFrame([("DATE",), ("BADGE",)], "entity_type string")
    got = {r.entity_type: r for r in policy.compliance_mapping(types).collect()}
    assert (got["DATE"].GDPR, got["DATE"].SOX, got["BADGE"].HIPAA) == ("GENERALIZE", "PASS", "N/A")


def test_conflicts_count_each_order(spark):
    actions = ["REDACT", "MASK", "REDACT", "MASK", "MASK", "PASS"]
    roles = [["a"], None, ["a", "a"], [], ["b"], ["b", "a"]]
    rules = [("p", 10 + i, "SSN", a, r, None) for i, (a, r) in enumerate(zip(actions, roles))]
    got = {
        (r.action_a, r.pos_a, r.action_b, r.pos_b): (r.rule_pairs, r.in_order, r.reversed, r.next_pos_a)
        for r in policy.conflicts(spark.createDataFrame(rules, RULES)).collect()
    }
    assert got == {
        ("REDACT", 10, "MASK", 11): (4, 3, 1, 12),
        ("REDACT", 10, "PASS", 15): (2, 2, 0, None),
        ("MASK", 11, "PASS", 15): (2, 2, 0, None),
        ("MASK", 14, "PASS", 15): (1, 1, 0, None),
    }


def test_conflicts_are_counted_alike_in_rows_and_by_running_numbers(spark):
    """Whether places are in a rule's row or not, and against all pairs of places; pairs
    are not shuffled after they are found."""
    lists = [None, ["a"], ["b"], ["a", "b"], ["c", "b", "a"]]
    rules = [(f"p{i % 2}", i * 7 % 101, "SSN", ("REDACT", "MASK", "PASS", None)[i * i % 11 % 4], lists[i % 13 % 5], None) for i in range(101)]
    want = {}
    for p, i, _, x, r, _ in rules:
        for q, j, _, y, s, _ in rules:
            if p == q and i < j and x and y and x != y and (not r or not s or set(r) & set(s)):
                n = want.setdefault((p, frozenset([(x, tuple(sorted(r or ()))), (y, tuple(sorted(s or ())))])), {})
                n.setdefault((x, y), []).append((i, j))
    expected = []
    for (p, _), n in want.items():
        (x, y), ordered = min(n.items(), key=lambda e: min(min(place) for place in e[1]))
        back = n.get((y, x), [])
        expected.append((p, min(i for i, _ in ordered), min(j for _, j in ordered), len(ordered), len(back), min(back)[1] if back else None))
    df = spark.createDataFrame(rules, RULES)
    for most in (1, 3, 128):
        got = policy.conflicts(df, max_places=most)
        rows = [(r.policy_id, r.pos_a, r.pos_b, r.in_order, r.reversed, r.next_pos_a) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(expected, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" not in plan and plan.count("Aggregate") == 3  # the actions of every place


def test_conflicts_of_small_types_take_one_shuffle(spark):
    """Types of few lines are gathered, larger ones meet in the index: the same rows, and
    lines of small types are shuffled once.  Rules without a policy meet nothing."""
    lists = [None, ["a"], ["b"], ["a", "b"], ["c", "b", None], [None]]
    rules = [
        (None if i % 29 == 5 else f"p{i * i % 7}", i * 31 % 997, ("SSN", "EMAIL", None)[i % 5 % 3], ("REDACT", "MASK", "PASS", None)[i * 7 % 11 % 4], lists[i % 13 % 6], None)
        for i in range(600)
    ]
    df = spark.createDataFrame(rules, RULES)
    rows = {most: sorted(policy.conflicts(df, max_places=most).collect(), key=str) for most in (1, 12, 128)}
    lines = sorted(r["count"] for r in df.where("policy_id IS NOT NULL AND entity_type IS NOT NULL AND action IS NOT NULL").groupBy("policy_id", "entity_type").count().collect())
    assert 4 < lines[0] <= 48 < lines[-1] <= 512  # all large, some, none
    assert rows[1] == rows[12] == rows[128] and len(rows[1]) > 100
    plan = policy.conflicts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_conflicts_in_both_orders_are_two_warnings(spark):
    document = '{"rules": [{"entity_type": "SSN", "action": "%s"}, {"entity_type": "SSN", "action": "%s"}, {"entity_type": "SSN", "action": "%s"}]}'
    documents = [("p", document % ("REDACT", "MASK", "REDACT")), ("q", document % ("MASK", "MASK", "PASS"))]
    got = {r.policy_id: r.warnings for r in policy.validate(spark.createDataFrame(documents, "policy_id string, document string")).collect()}
    assert got["p"] == ["Conflict: SSN: conflicting actions REDACT vs MASK", "Conflict: SSN: conflicting actions MASK vs REDACT"]
    assert got["q"] == ["Conflict: SSN: conflicting actions MASK vs PASS"]


def test_many_role_lists_of_one_policy(spark):
    """Every list has a role of its own and one that all of an action share."""
    n = 100_000
    rules = spark.range(n).select(
        F.lit("p").alias("policy_id"), F.col("id").alias("pos"), F.lit("SSN").alias("entity_type"),
        F.when(F.col("id") % 2 == 0, "MASK").otherwise("PASS").alias("action"),
        F.array(F.concat(F.lit("r"), F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, "even").otherwise(F.concat(F.lit("r"), (F.col("id") - 1).cast("string")))).alias("roles"),
    )
    got = policy.conflicts(rules)
    assert got.count() == n // 2 and got.where("pos_b <> pos_a + 1 OR rule_pairs <> 1 OR in_order <> 1").count() == 0


def test_requests_are_shuffled_once(spark):
    """Without broadcasts, request rows meet all that their policy says in one join."""
    rows = spark.createDataFrame([("p", "SSN", "a", "r")], "policy_id string, entity_type string, agent_id string, agent_role string")
    rules = spark.createDataFrame([("p", 0, "SSN", "MASK", None, None)], RULES)
    exceptions = spark.createDataFrame([("p", 0, "a", None, ["SSN"], "PASS")], "policy_id string, pos bigint, agent_id string, agent_role string, entity_types array<string>, action string")
    packs = spark.createDataFrame([("p", ["GDPR"])], "policy_id string, compliance_packs array<string>")
    decided = policy.evaluate(rows, rules, exceptions, packs)
    joins = [line for line in decided._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1
    assert [(r.action, r.compliance_refs) for r in decided.collect()] == [("PASS", [])]


def test_a_policy_is_folded_to_few_rows(spark):
    """Packs are not listed for every type, nothing is sorted to find the last positions, and
    types that share a row keep their own rules and exceptions."""
    types = [f"T{i}" for i in range(60)]
    rules = spark.createDataFrame([("p", i, t, f"R{i}", ["r"] if i % 3 == 0 else None, None) for i, t in enumerate(types)], RULES)
    exceptions = spark.createDataFrame(
        [("p", i, "a" if i % 2 else None, None if i % 2 else "r", [t], f"X{i}") for i, t in enumerate(types) if i % 5 == 0],
        "policy_id string, pos bigint, agent_id string, agent_role string, entity_types array<string>, action string",
    )
    packs = spark.createDataFrame([("p", ["GDPR"]), ("q", ["HIPAA"])], "policy_id string, compliance_packs array<string>")
    assert policy._folded(rules, exceptions, packs).count() == 2 * policy.TYPE_ROWS < 22
    asked = [(p, t, agent, role) for p in "pq" for t in [*types, "EMAIL", None] for agent in ("a", "b", None) for role in ("r", "s", None)]
    rows = spark.createDataFrame(asked, "policy_id string, entity_type string, agent_id string, agent_role string")
    decided = policy.evaluate(rows, rules, exceptions, packs)
    assert "SortAggregate" not in decided._jdf.queryExecution().executedPlan().toString()

    def expected(p, t, agent, role):
        if p == "q" or t not in types:
            return "TOKENIZE" if t == "EMAIL" else "REDACT"
        i = types.index(t)
        if i % 5 == 0 and (agent == "a" if i % 2 else role == "r"):
            return f"X{i}"
        return "REDACT" if i % 3 == 0 and role == "s" else f"R{i}"

    got = {(r.policy_id, r.entity_type, r.agent_id, r.agent_role): r.action for r in decided.collect()}
    assert got == {key: expected(*key) for key in asked}


def test_strictest_actions_need_no_join_of_lines(spark):
    """An id has one row of fixed width, however many lines have it."""
    from veilframe.plans import all_queries

    df = all_queries()[0]["pol_most_restrictive"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_" not in plan and plan.count("Aggregate") == 1
