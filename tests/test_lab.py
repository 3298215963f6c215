import subprocess

import pytest
from pyspark.sql import functions as F

from logveil.operators import lab, leaks, masking, templates
from logveil.rules import registry


@pytest.mark.parametrize(
    "sample,value,enabled,verdict",
    [
        ("user=pkim", "pkim", lab.CATEGORIES, "already_masked"),
        ("sha256=" + "a" * 64, "a" * 64, lab.CATEGORIES, "protected"),
        ("from 10.1.2.3", "10.1.2.3", ("identities",), "category_off"),
        ("user=root", "root", lab.CATEGORIES, "rejected"),
        ("thing QQ77", "QQ77", lab.CATEGORIES, "no_match"),
        ("thing", "QQ77", lab.CATEGORIES, None),
    ],
)
def test_ladder(sample, value, enabled, verdict):
    assert lab.diagnose(sample, value, enabled)["verdict"] == verdict
    brief = lab.diagnose(sample, value, enabled, brief=True)
    assert [brief.get(k) for k in ("verdict", "label", "occurrences")] == [lab.diagnose(sample, value, enabled).get(k) for k in ("verdict", "label", "occurrences")]


def test_diagnoses_are_dealt_to_all_cores(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.concat(F.lit("thing QQ"), "event_id").alias("sample"), F.concat(F.lit("QQ"), "event_id").alias("value"))
    told = lab.diagnosed(events, id_col="event_id")
    assert told.select(F.spark_partition_id().alias("task")).distinct().count() == spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in told.groupBy("verdict", "label", "occurrences").count().collect()] == [("no_match", "USER", 1, 1000)]


def test_places_of_a_value():
    assert lab.occurrences("aaa a", "aa") == [0, 1] and lab.occurrences("a", "") == [] == lab.occurrences("a", "b")


def test_proposals_mask_the_value():
    got = lab.suggest("2024 assetTag=QQ77 seen", "QQ77")
    assert [p["kind"] for p in got["proposals"]] == ["extend_builtin", "new_pattern", "literal"] and got["label"] == "HOST"
    assert all(p["also_masked"] == [] for p in got["proposals"])
    assert all(p["label"] == "CUSTOM" for p in lab.suggest("user=root", "root")["proposals"])
    assert lab.suggest("user=pkim", "pkim")["proposals"] == []


def test_one_process_tries_many_patterns(monkeypatch):
    started = []

    class Counted(subprocess.Popen):
        def __init__(self, *args, **more):
            started.append(args)
            super().__init__(*args, **more)

    monkeypatch.setattr(subprocess, "Popen", Counted)
    for n in range(20):
        assert [p["kind"] for p in lab.suggest(f"2024 assetTag=RR{n} seen", f"RR{n}")["proposals"]] == ["extend_builtin", "new_pattern", "literal"]
    assert len(started) <= 1
    for bad in ("(b+)+$", "(c+)+$"):
        with pytest.raises(ValueError, match="backtracks"):
            registry.validate(bad)
        assert registry.validate(f"{bad[1]}+") == f"{bad[1]}+"  # after one that was killed
    assert len(started) <= 3


def test_proposals_of_many_rows(spark):
    rows = [(k, f"2024 assetTag=QQ{k % 3} seen" if k % 5 else None, f"QQ{k % 3}") for k in range(40)]
    got = lab.suggested(spark.createDataFrame(rows, "doc_id long, sample string, value string")).collect()
    assert sorted((r.doc_id, r.place, r.kind, r.regex) for r in got) == [(k, n, p["kind"], p["regex"]) for k, s, v in rows if s for n, p in enumerate(lab.suggest(s, v)["proposals"], 1)]


def test_tried_patterns():
    got = lab.try_regex("Q1 Q2 user=pkim", r"Q\d")
    assert [m["value"] for m in got["matches"]] == ["Q1", "Q2"] and got["newly_masked"] == ["Q1", "Q2"]


def test_anchors():
    for sample, value, kind, key in (("<Data Name='X1'>v</Data>", "v", "xml_data", "X1"), ("<Host>v<", "v", "xml", "Host"), ("-Server v", "v", "param", "Server"), ("  Account Name:  v", "v", "kv", "Account Name"), ("a=b key=v", "v", "kv", "key"), ("v", "v", "bare", None)):
        at = sample.rindex(value) if kind != "xml_data" else sample.index(">v") + 1
        got = lab.anchor(sample, at, at + 1)
        assert (got["kind"], got["key"]) == (kind, key), sample


def test_residue(spark):
    rows = spark.createDataFrame(
        [(1, "10.1.2.3 10.1.2.3 127.0.0.1 a@b.io WS-FIN-07 UTF-8 CVE-2024-1"), (2, " "), (3, "ann Annx ann tok3nABCDEFGHIJKLMNOP45 " + "ab" * 16), (4, " ".join(f"10.0.0.{i}" for i in range(1, 40)))],
        "doc_id long, masked string",
    )
    mapping = spark.createDataFrame([(3, "[USER_1]", "ann", 1), (3, "[USER_2]", "tok3nABCDEFGHIJKLMNOP45", 2)], "doc_id long, placeholder string, value string, ord int")
    got = [(r.doc_id, r.type, r.value, r["count"]) for r in leaks.scan(rows, mapping, custom_terms=["ANN"]).orderBy("doc_id", "rank").collect()]
    assert got[:3] == [(1, "email", "a@b.io", 1), (1, "ip_address", "10.1.2.3", 2), (1, "host_like", "WS-FIN-07", 1)]
    third = [g[1:] for g in got if g[0] == 3]
    assert ("custom_term", "ANN", 2) in third and ("known_value", "tok3nABCDEFGHIJKLMNOP45", 1) in third and ("secret_like", "ab" * 16, 1) in third
    assert sum(g[0] == 4 for g in got) == 25 and not any(g[0] == 2 for g in got)
    assert leaks.scan(rows, keep_terms=["ws-fin-07"], enabled=("network",)).where("type = 'host_like'").count() == 0
    assert {r.doc_id for r in leaks.blocking(leaks.scan(rows)).collect()} == {1, 4}


def test_templates(spark):
    rows = spark.createDataFrame([(1, "sshd: Failed password for invalid user x; account locked out 4625"), (2, "nothing here"), (3, "")], "doc_id long, text string")
    got = templates.suggest(rows).collect()
    assert got[0].template_id == "brute_force" and {r.doc_id for r in got} == {1}
    own = [{"template_id": "mine", "name": "Mine", "keywords": ["NOTHING", " "]}]
    assert [(r.doc_id, r.template_id, r.score) for r in templates.suggest(rows, custom=own).where("template_id = 'mine'").collect()] == [(2, "mine", 1.0)]
    assert templates.library(spark, {"phishing": {"name": "Fish", "template_id": "no"}}, own).where("name in ('Fish', 'Mine')").count() == 2
    assert templates.slug("Mine!", {"mine", "mine_2"}) == "mine_3"


def test_sql_functions(spark):
    masking.register(spark)
    assert spark.sql("select mask_text('mail a@x.io') m").first().m == "mail [EMAIL_1]"
    assert spark.sql("select unmask_text('[EMAIL_1]', map('[EMAIL_1]', 'a@x.io')) m").first().m == "a@x.io"
    assert spark.sql("select is_accepted('IP', '127.0.0.1') a").first().a is False
    assert spark.sql("select value, label from detect_spans('1', 'mail a@x.io')").first().value == "a@x.io"


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "a@x.io"), (2, "a@x.io")], "doc_id long, text string").withColumn("masked", F.lit("x"))
    got = masking.mask(rows).orderBy("doc_id", "masked").collect()
    assert [r.masked for r in got] == [None, "", "[EMAIL_1]", "[EMAIL_1]"]


def test_settings():
    from logveil.operators import providers

    defaults = {"provider": "openai", "provider_models": {"openai": "a", "google": "b"}, "x": 1}
    assert providers.merged_settings({"model": "old"}, defaults)["provider_models"] == {"openai": "old", "google": "b"}
    assert providers.merged_settings({"model": "old", "provider_models": {"openai": "c"}}, defaults) == {"provider": "openai", "provider_models": {"openai": "c", "google": "b"}, "x": 1}
    assert providers.system_prompt({}, "D", instructions=" i ") == "D\n\nAdditional user instructions:\ni"
    assert providers.system_prompt({"system_prompt": "S"}, "D", use_system=False, instructions="i", schema="!") == "i!"
