import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logveil.operators import kernel, vaulting
from logveil.operators.kernel import Known, MaskConfig, Session


def one_by_one(rows, config=None):
    """Incidents one after the other through one session: (id, ord) -> masked text and the placeholders that it has."""
    session, out = Session(config), {}
    for incident, order, text in sorted(rows, key=lambda r: (r[1], r[0])):
        masked, _ = session.mask(text or "")
        out[incident, order] = masked, kernel.used(session.mapping, masked)
    return out


def found(frame):
    return {(r.incident_id, r.ord): (r.masked, dict(r.mapping)) for r in frame.collect()}


def incidents(spark, rows):
    frame = spark.createDataFrame(rows, "incident_id string, ord long, text string")
    for clash in ("row", "offers", "spans", "mark", "place", "word"):
        frame = frame.withColumn(clash, F.lit("clash"))
    return frame


def test_conversations_as_one_vault(spark, small):
    rows = [(f"c{r.conv_id}", r.conv_id * 100 + r.turn, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert found(vaulting.vaulted(incidents(spark, rows))) == one_by_one(rows)


#: What is known hides more, which makes more known, so that rounds are needed.
CHAIN = [
    ("a", 1, "login user=jdoe from 10.1.2.3"), ("b", 2, "then jdoe said token: *** ok"), ("c", 3, "a *** b, host=ws-1.corp.lan and ws-1 again"), ("d", 4, "ws-1 says [USER_1] and [HOST_9] and [USER_2]"),
    ("e", 5, "user=CORP\\mia login"), ("f", 6, "CORP\\mia CORP mia user=mia"), ("g", 6, "mia"), ("h", 7, None), ("i", 8, ""), ("j", 9, "plain *x* jdoes 10.1.2.3"), ("j", 10, "plain *x* jdoes 10.1.2.3"),
]


@pytest.mark.parametrize("config", [MaskConfig(), MaskConfig(base_mapping={"[USER_7]": "mia", "odd": "plain", "[HOST_2]": "ws-1"}, base_counters={"IP": 5})])
def test_rounds(spark, config):
    assert found(vaulting.vaulted(incidents(spark, CHAIN), config)) == one_by_one(CHAIN, config)


def test_random_incidents(spark):
    rng = random.Random(4)
    parts = ["user=u{}", "u{}", "host=srv-{}.lan", "srv-{}", "10.0.0.{}", "u{}@corp.io", "corp", "DOM{}\\u{}", "password=p{}!", "p{}!", "[USER_{}]", "token: **", "**"]
    rows = [(f"i{k}", k, " ".join(rng.choice(parts).replace("{}", str(rng.randrange(6))) for _ in range(rng.randrange(9)))) for k in range(300)]
    assert found(vaulting.vaulted(incidents(spark, rows))) == one_by_one(rows)


def test_nothing(spark):
    assert vaulting.vaulted(incidents(spark, CHAIN).limit(0)).collect() == []


def pattern_by_pattern(mapping, text):
    """Places of known values by one pattern for each, the longest first, later entries first."""
    out = []
    for k, (p, v) in sorted(enumerate(mapping.items()), key=lambda x: (-len(x[1][1]), -x[0])):
        m = kernel.PLACEHOLDER.fullmatch(p)
        out += [(*s.span(), m[1] if m else "CUSTOM") for s in re.finditer(kernel.literal(v), text)] if v else []
    return out


def test_known_values_against_a_pattern_for_each():
    rng = random.Random(1)
    pieces = ["a", "b", "ab", "-", ".", " ", "é", "_", "**", "9"]
    for _ in range(300):
        values = ["".join(rng.choices(pieces, k=rng.randrange(1, 4))) for _ in range(8)] + ["x", "x", ""]
        mapping = {f"[USER_{k}]" if k % 3 else f"odd {k}": v for k, v in enumerate(values)}
        text = "".join(rng.choices(pieces, k=40))
        at_once, layered = Known(mapping), Known()
        for p, v in mapping.items():
            layered.add({p: v})
        assert at_once.find(text) == layered.find(text) == pattern_by_pattern(mapping, text)


def test_a_hundred_thousand_known_values_cost_about_what_a_hundred_do():
    text = "the value123 and then some words of no matter, again " * 200

    def seconds(n):
        known = Known({f"[USER_{k}]": f"value{k}" for k in range(n)})
        began = time.process_time()
        for _ in range(5):
            assert len(known.find(text)) == 200 * (n > 123)
        return time.process_time() - began

    assert seconds(100_000) < 20 * seconds(1000) + 0.5


def test_a_session_is_the_same_as_masking_with_what_is_known():
    session, mapping = Session(), {}
    for text in ("user=jdoe 10.1.2.3", "jdoe and user=mia at 10.9.9.9", "mia jdoe"):
        masked, mapping, _ = kernel.mask(text, MaskConfig(base_mapping=mapping))
        assert session.mask(text)[0] == masked
    assert session.mapping == mapping
    resumed = Session(learned=session.learned)
    assert resumed.mask("user=new and mia")[0] == session.mask("user=new and mia")[0] == "user=[USER_3] and [USER_2]"
