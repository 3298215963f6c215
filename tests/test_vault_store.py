import pytest

from logveil.operators import vault as v

SEEN = "incident_id string, time string, placeholder string, value string, ord long"


def seen(spark, *rows):
    return spark.createDataFrame([(i, f"2024-01-0{n}T00:00:00", p, x, n) for n, (i, p, x) in enumerate(rows, 1)], SEEN)


def rows(vault):
    return {name: sorted(tuple(r) for r in getattr(vault, name).collect()) for name in v.TABLES}


@pytest.mark.parametrize("key", [None, "0123456789abcdef"])
def test_saves_write_only_what_has_changed(spark, tmp_path, key):
    path = str(tmp_path / "vault")
    first, _ = v.record(v.empty(spark), seen(spark, ("i1", "[USER_1]", "ann"), ("i1", "[HOST_1]", "ws"), ("i2", "[USER_1]", "ann")))
    one = v.save(first, path, key)
    assert rows(one) == rows(first) and one.version == 1
    more, _ = v.record(one, seen(spark, ("i3", "[USER_2]", "bob")))
    two = v.save(more, path, key)
    gone = v.forget_terms(two, ["WS"])
    three = v.save(gone, path, key)
    want = rows(v.forget_terms(v.record(first, seen(spark, ("i3", "[USER_2]", "bob")))[0], ["ws"]))
    assert rows(three) == want == rows(v.load(spark, path, key))
    assert rows(v.load(spark, path, key, 1)) == rows(first)
    count = lambda n, name: spark.read.parquet(f"{path}/version={n}/{name}").count()
    assert [count(2, name) for name in v.TABLES] == [1, 1, 1, 1]  # one of each, the counter of users among them
    assert [count(3, name) for name in v.TABLES] == [1, 0, 1, 0]  # tombstones
    whole = v.save(three, path, key, whole=True)
    assert rows(whole) == want and count(4, "entities") == 2
    assert "bob" in {r[3] for r in want["entities"]} and (key is None) == ("bob" in {r.value for r in spark.read.parquet(f"{path}/version=4/entities").collect()})


def test_two_savers_never_take_one_version(spark, tmp_path):
    path = str(tmp_path / "vault")
    first, _ = v.record(v.empty(spark), seen(spark, ("i1", "[USER_1]", "ann")))
    v.save(first, path)
    a, b = v.load(spark, path), v.load(spark, path)
    v.save(v.record(a, seen(spark, ("i2", "[USER_2]", "bob")))[0], path)
    with pytest.raises(v.Conflict):
        v.save(v.record(b, seen(spark, ("i2", "[USER_2]", "eve")))[0], path)
    again = v.save(v.record(v.load(spark, path), seen(spark, ("i3", "[USER_3]", "eve")))[0], path)
    assert again.version == 3 and [r[3] for r in rows(again)["entities"]] == ["ann", "bob", "eve"]
    v._claim(spark, path, 4)  # another one is saving now
    with pytest.raises(v.Conflict):
        v.save(again, path)


def test_a_save_that_fails_can_be_tried_again(spark, tmp_path):
    path = str(tmp_path / "vault")
    one = v.save(v.record(v.empty(spark), seen(spark, ("i1", "[USER_1]", "ann")))[0], path)
    broken = v.Vault(one.entities, one.incidents, one.bridge, one.counters.selectExpr("assert_true(false) is null as label", "n").selectExpr("cast(label as string) as label", "n"), one.version)
    with pytest.raises(Exception, match="assert|true"):
        v.save(broken, path)
    assert rows(v.load(spark, path)) == rows(one) and v.save(v.clear(one), path).version == 2


def test_a_save_that_was_given_up_is_passed_over(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vault")
    one = v.save(v.record(v.empty(spark), seen(spark, ("i1", "[USER_1]", "ann")))[0], path)
    v._claim(spark, path, 2)
    monkeypatch.setattr(v, "STALE_MS", -1)
    two = v.save(v.clear(one), path)
    assert two.version == 3 and rows(two) == {"entities": [], "incidents": [], "bridge": [], "counters": [("USER", 1)]}
    with pytest.raises(FileNotFoundError):
        v.load(spark, path, version=2)
