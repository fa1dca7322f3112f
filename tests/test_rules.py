import random

import pytest

from convolake.operators import rules as R
from convolake.schemas import RULES, conform


def dedup(spark, stored, new):
    rules = conform(spark.createDataFrame(stored, "project_path string, rule_text string"), RULES)
    rows = spark.createDataFrame(new, "project_path string, rule_seq long, rule_text string")
    return sorted((r.project_path, r.rule_seq, r.rule_text) for r in R.dedup_rules(rules, rows).collect())


def near(rule, known):
    """The rule's first fifty characters occur in the known one, or both say the same."""
    a, b = rule.lower(), known.lower()
    return a[:50] in b or a.strip() == b.strip()


@pytest.mark.parametrize("seed", range(3))
def test_every_rule_is_new_or_has_an_earlier_rival(spark, seed):
    rng = random.Random(seed)
    stems = ["use the cache", "Use The Cache always", "cache", "never run tests twice in a row " * 3,
             "run", "tests twice", "  cache ", "row never run", ""]
    def text():
        return (rng.choice(stems) + rng.choice(["", " ", " x", " when building"]) + rng.choice(["", rng.choice(stems)]))
    stored = [(f"p{rng.randrange(6)}", text()) for _ in range(8)]
    new = [(f"p{rng.randrange(6)}", n, text()) for n in range(150)]
    kept = dedup(spark, stored, new)
    assert set(kept) <= set(new)
    for rule in new:  # a rule stays just if it is near to no stored and no earlier kept one
        rivals = [t for p, t in stored if p == rule[0]] + [t for p, n, t in kept if p == rule[0] and n < rule[1]]
        assert (rule in kept) == (rule[2] != "" and not any(near(rule[2], r) for r in rivals))


def test_refused_rule_refuses_nobody(spark):
    long = "a" * 50
    new = [("p", 1, long + " first"), ("p", 2, "x " + long + " y"), ("p", 3, "X")]
    # the second holds the first's beginning but not the other way round; the third is in the second
    assert dedup(spark, [], new) == new[:2]
    new = [("p", 1, "abc"), ("p", 2, "ab"), ("p", 3, "b"), ("p", 4, "zb")]
    assert dedup(spark, [], new) == [("p", 1, "abc"), ("p", 4, "zb")]


def test_add_and_clear(spark):
    sessions = spark.createDataFrame([("s1", "/a/web"), ("s2", "/a/api"), ("s3", None)], "session_id string, project_path string")
    rules = conform(spark.createDataFrame([], "project_path string, rule_text string"), RULES)
    rules = R.add_rule(rules, sessions, "A", "first")
    rules = R.add_rule(rules, sessions, "web", "second")
    rules = R.add_rule(rules, sessions, "api", "third")
    got = sorted((r.project_path, r.rule_seq, r.rule_text, r.source) for r in rules.collect())
    assert got == [("/a/api", 1, "first", "manual"), ("/a/api", 2, "third", "manual"), ("/a/web", 1, "second", "manual")]
    assert [r.rule_text for r in R.clear_rules(rules, "API").collect()] == ["second"]
    assert R.clear_rules(rules).count() == 0


def test_only_starts_leave_a_text(spark):
    """No row per character: long texts give the starts they hold, also over the ends of the steps."""
    start = "Größe " + "x" * 43 + "é"
    text = "ab " * 100_000 + start + " tail"
    rules = spark.createDataFrame([("p", 1, text), ("q", 2, text), ("p", 3, None), (None, 4, text)],
                                  "project_path string, rule_seq long, folded string")
    wanted = spark.createDataFrame([("p", start), ("p", "tail"), ("q", "no such"), ("p", "b a")], "project_path string, start string")
    assert R._candidates(rules, wanted).count() < 20
    found = sorted((r.project_path, r.rule_seq, r.start) for r in R._containing(rules, wanted).collect())
    assert found == sorted([("p", 1, start), ("p", 1, "tail"), ("p", 1, "b a")])
    for at in (R._BLOCK - 49, R._BLOCK - 25, R._BLOCK):
        split = spark.createDataFrame([("p", 1, "y" * at + start)], rules.schema)
        assert [r.start for r in R._containing(split, wanted).collect()] == [start]
