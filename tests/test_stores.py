"""Stores that a user edits, and what shows results to people."""

import json

import pytest
from pyspark.sql import functions as F

from logveil.operators import lab, ledger, masking, templates, verdicts
from logveil.rules.registry import RuleStore
from logveil.sources import text


def test_rates(spark, tmp_path):
    store = ledger.RateStore(tmp_path / "rates.json")
    store.set_rate(" My-Model ", 2, 4)
    store.set_rate("o3", 9, 9)
    for bad in (("", 1, 1), ("x", -1, 0)):
        with pytest.raises(ValueError):
            store.set_rate(*bad)
    store.clear_rate("O3 ")
    rows = spark.createDataFrame([("openai", "MY-MODEL", 10**6, 10**6), ("azure", "my-model", 0, 0), ("azure", "other", 0, 0), ("ollama", "my-model", 1, 1)], "provider string, model string, tokens_in long, tokens_out long")
    got = {(r.provider, r.model): (r.rate_source, r.cost) for r in ledger.priced(rows, store.overrides(spark)).collect()}
    assert got == {("openai", "MY-MODEL"): ("custom", 6.0), ("azure", "my-model"): ("custom", 0.0), ("azure", "other"): (None, 0.0), ("ollama", "my-model"): ("free", 0.0)}
    table = store.table(spark).orderBy("ord").collect()
    assert [r.model for r in table if not r.pattern] == ["my-model"] and table[0].pattern and len(table) == len(ledger.RATES) + 1


def test_amounts(spark):
    rows = spark.createDataFrame([(0.0,), (0.004,), (1.5,), (-0.5,), (1234.6,), (None,)], "n double")
    assert [r.m for r in rows.select(ledger.money(F.col("n")).alias("m")).collect()] == ["$0.00", "$0.0040", "$1.50", "$-0.50", "$1235", "—"]
    counts = spark.createDataFrame([(950,), (1234,), (34_500,), (5_600_000,), (12_300_000,)], "n long")
    assert [r.m for r in counts.select(ledger.compact(F.col("n")).alias("m")).collect()] == ["950", "1.2K", "35K", "5.6M", "12M"]
    cards = spark.createDataFrame([("a", 0, "metered"), ("b", 2, "metered"), ("c", 5, "free"), ("d", 0, "licensed"), ("e", 0, "metered")], "provider string, requests_all long, cost_model string")
    assert {r.provider for r in ledger.relevant(cards, ["d"], "e").collect()} == {"b", "d", "e"}


def test_templates(spark, tmp_path):
    store = templates.TemplateStore(tmp_path / "templates.json")
    first = store.library(spark).orderBy("ord").first()
    assert first.prompt and first.mitre.startswith(first.tactic) and not first.modified and not first.custom
    store.save(first.template_id, {"name": "Mine", "category": first.category})
    assert store.overrides() == {first.template_id: {"name": "Mine"}} and store.library(spark).where("modified").first().name == "Mine"
    store.save(first.template_id, {"name": first.name})
    assert store.overrides() == {}
    new = store.create({"name": "DNS Odd!", "prompt": "Look.", "keywords": [" tunnel ", ""]})
    assert new == "dns_odd" and store.create({"name": "dns odd", "prompt": "x"}) == "dns_odd_2"
    store.save(new, {"keywords": ["tunnel", "zebra"], "prompt": "Look again."})
    own = store.library(spark).where("custom").orderBy("ord").first()
    assert (own.template_id, own.prompt, own.keywords, own.category) == (new, "Look again.", ["tunnel", "zebra"], "Custom")
    texts = spark.createDataFrame([(1, "a zebra and a tunnel"), (2, None), (3, "  ")], "doc_id long, text string")
    assert [(r.doc_id, r.template_id) for r in templates.suggest(texts, custom=store.custom()).collect()] == [(1, new)]
    for call in (lambda: store.delete(first.template_id), lambda: store.delete("none"), lambda: store.reset(new), lambda: store.create({"name": "x"}), lambda: store.save(new, {"name": " "}), lambda: store.save("none", {})):
        with pytest.raises(ValueError):
            call()
    store.save(first.template_id, {"prompt": "Other."})
    store.reset(first.template_id)
    store.delete(new)
    assert store.overrides() == {} and [c["template_id"] for c in store.custom()] == ["dns_odd_2"]


def test_older_stores_are_taken_over(tmp_path):
    old = tmp_path / "workspaces.json"
    old.write_text(json.dumps({"active": "b", "workspaces": {"a": {}, "b": {"custom_terms": ["Acme", "ACME", 3], "custom_patterns": [{"label": "X", "regex": "x+"}, {"label": "Y"}]}}}))
    store = RuleStore(tmp_path / "rules")
    assert store.migrate(old) and store.terms() == ["Acme"] and store.patterns() == [{"label": "X", "regex": "x+"}]
    assert not store.migrate(old) and not RuleStore(tmp_path / "none").migrate(tmp_path / "missing.json")


def test_verdict_prompt_asks_for_what_is_read(spark, tmp_path):
    prompt = verdicts.schema_prompt()
    shape = json.loads(prompt.split("```json\n")[1].split("\n```")[0])
    assert set(shape) == {f.name for f in spark.createDataFrame([], verdicts.SCHEMA).schema}
    rows = spark.createDataFrame([(1, 'x\n```json\n{"verdict": "false_positive"}\n```', {})], "id long, text string, mapping map<string,string>")
    parsed = verdicts.parse(rows, "id", "text", "mapping")
    verdicts.write(parsed, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first().verdict.verdict == "false_positive"


def test_restored_values_are_marked_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<[USER_1]> on [HOST_1], [HOST_9]", {"[USER_1]": "srv", "[HOST_1]": "srv&one"})], "doc_id long, masked string, mapping map<string,string>")
    html = rows.select(text.restored(F.col("masked"), F.col("mapping")).alias("h")).first().h
    assert html == '&lt;<mark title="[USER_1]">srv</mark>&gt; on <mark title="[HOST_1]">srv&amp;one</mark>, [HOST_9]'
    text.write_masked(rows, str(tmp_path / "t"))
    text.write_masked(rows, str(tmp_path / "h"), html=True)
    assert next((tmp_path / "t" / "doc_id=1").glob("*.txt")).read_text() == "<[USER_1]> on [HOST_1], [HOST_9]\n"
    assert "<mark>[USER_1]</mark>" in next((tmp_path / "h" / "doc_id=1").glob("*.txt")).read_text()
    assert [(r.field, r.value) for r in masking.field_table(rows).collect()] == [("Hostname / device", "srv&one"), ("Username", "srv")]


def test_proposals_stay_at_their_place():
    sample = "2024 asset tag=QQ77 and more text follows here for a while, longer than the value is"
    assert not lab.takes_place(r"tag=(.*)", sample, *(sample.index("QQ77") + k for k in (0, 4)))
    assert lab.takes_place(r"tag=(\w+)", sample, *(sample.index("QQ77") + k for k in (0, 4))) and not lab.takes_place("(", sample, 0, 1)
    assert lab._widened(r"(?i)\b(?:user|login)=(\S+)", "user") == []
    assert lab._widened(r"(?i)\b(?:user|login)=(\S+)", "staff name") == [r"(?i)\b(?:staff[ _\-]?name|user|login)=(\S+)"]
    found = lab.suggest("x staffuser=pkim7 y", "pkim7") if lab.diagnose("x staffuser=pkim7 y", "pkim7")["verdict"] == "no_match" else {"proposals": []}
    assert all(lab.takes_place(p["regex"], "x staffuser=pkim7 y", 12, 17) for p in found["proposals"])
