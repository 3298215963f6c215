import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logveil.functions.accept import accepted, veto, veto_column
from logveil.operators import masking
from logveil.operators.kernel import Views, needed
from logveil.plans import rendered
from logveil.plans.queries import ACCEPT_CASES
from logveil.rules import registry
from logveil.rules import values as V


def test_inventory():
    rules = registry.defaults()
    assert len(rules) == 96 and len(V.KEEP_PATTERNS) == 12 and len({r.rule_id for r in rules}) == 96
    assert {r.category for r in rules} == set(registry.CATEGORIES)
    assert set(rendered.LINES) == {r.rule_id for r in rules} == set(V.NOTES)


def test_catalyst_and_python_find_the_same(spark, small):
    lines = rendered.lines(spark, small).select("event_id", "line").limit(400).cache()
    texts = [(r.event_id, r.line) for r in lines.collect()]
    picked = [masking.rule_values(F.col("line"), r[0]).alias(r[0]) for r in V.RULES[::4]]
    found = {r.event_id: r for r in lines.select("event_id", *picked).collect()}
    for event, line in texts:
        for rule_id, _, label, _, regex in V.RULES[::4]:
            want = [v for m in re.finditer(regex, line) if (v := line[slice(*m.span(m.lastindex or 0))]) and accepted(label, v)]
            assert found[event][rule_id] == want, (rule_id, line)


def test_unicode_and_line_ends_match_as_in_python(spark):
    texts = ["über user=jörg\rx\nUser: Zoë Ä \r\nnext", "host=[a] mail ä@b.de,c@d.io", "QueryName: x.lan\x85y", "a\u2028User: b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for rule_id in ("sysmon-user", "email", "user-kv", "host-kv", "sysmon-dns-query", "fqdn"):
        _, _, label, _, regex = next(r for r in V.RULES if r[0] == rule_id)
        got = {r.k: r.v for r in rows.select("k", masking.rule_values(F.col("t"), rule_id).alias("v")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == [v for m in re.finditer(regex, t) if (v := t[slice(*m.span(m.lastindex or 0))]) and accepted(label, v)], (rule_id, t)


@pytest.mark.parametrize("rule", V.RULES, ids=lambda r: r[0])
def test_what_a_rule_needs_is_in_what_it_matches(rule):
    line = rendered.LINES[rule[0]].replace("{x}", "0123456789abcdef" * 2).replace("{u}", "user12").replace("{h}", "SRV-A-07").replace("{ip}", "10.3.4.5").replace("{n}", "12")
    found = [m[0].lower() for m in re.finditer(rule[4], line)]
    assert found
    assert Views(line).may_match(needed(rule[4]))
    assert Views(f"x{line}").may_match(needed(rule[4])) or not re.search(rule[4], f"x{line}")


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([r[4] for r in V.RULES]), st.data())
def test_what_a_rule_needs_is_in_whatever_it_matches(regex, data):
    text = data.draw(st.from_regex(regex))
    assert Views(text).may_match(needed(regex))


def test_veto_cases(spark):
    for label, value, why in ACCEPT_CASES:
        assert veto(label, value) == why, (label, value)
    rows = spark.createDataFrame([(a, b) for a, b, _ in ACCEPT_CASES], "a string, b string")
    got = [r.v for r in rows.select(veto_column(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [w for _, _, w in ACCEPT_CASES]
    assert veto("IPV6", "0:0:0:0:0:0:0:1") == "R18" and accepted("IPV6", "fe80::1")


def test_overrides_and_validation(tmp_path):
    store = registry.RuleStore(tmp_path)
    store.set_override("mac", r"\b[0-9a-f]{12}\b")
    assert [r.rule_id for r in registry.effective(store.overrides()) if r.modified] == ["mac"]
    store.set_override("mac", next(r.regex for r in registry.defaults() if r.rule_id == "mac"))
    assert store.overrides() == {}
    for bad in ("", "(", "x" * 501, "(a+)+$"):
        with pytest.raises(ValueError):
            registry.validate(bad)
    with pytest.raises(ValueError):
        store.set_override("nothing", "x")
    assert not any(r.modified for r in registry.effective({"mac": "("}))


def test_stores(tmp_path):
    store = registry.RuleStore(tmp_path)
    assert store.save_terms([" Acme", "ACME", "", "x"]) == ["Acme", "x"]
    with pytest.raises(ValueError):
        store.add_keep_term("acme")
    with pytest.raises(ValueError):
        store.add_keep_term("a")
    assert store.add_keep_term("Contoso") == ["Contoso"]
    store.save_terms(["contoso"])
    assert store.keep_terms() == []
    assert store.add_pattern("code x!", r"\bQ\d+") == {"label": "CODEX", "regex": r"\bQ\d+"}
    with pytest.raises(ValueError):
        store.add_pattern("other", r"\bQ\d+")
    store.delete_pattern(r"\bQ\d+")
    (tmp_path / "custom_patterns.json").write_text("broken")
    assert store.patterns() == []
    assert registry.split_terms("a, b\n\nc") == ["a", "b", "c"]
