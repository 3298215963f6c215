import random

import pytest

from logveil.operators import layout, structural

TABLE = ["Name         SamAccountName  Enabled", "------------ --------------  -------", "Ann Lee      alee            True", "Bob          a.very.long.name True", "x@y.org      10.0.0.1        No", "             z"]
EXPORT = ["id,user,device,count", '1,"Lee, ""Ann""",box1,2', "2, bob\t,,", '3,"open, box2,9', "4,10.1.1.1,a@b.org,1,more", "", "  ", '5,""x,b3\r']
PIECES = [*TABLE, *EXPORT, "", " \t", "---- ----", "ä\U0001f600 plain", "Status  Name", "------  ----", "Running spool", "\u2003\u00a0", "a\tuser\thost\tb", "1\tu1\th1\t2", "{\"user\",a,b,c", " "]


def expected(lines):
    text = "\n".join("" if v is None else v for v in lines)
    return sorted([("export", *s) for s in structural.delimited(text)] + [("table", *s) for s in structural.tables(text)])


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_spans_are_those_of_whole_texts(spark, block):
    rng = random.Random(block)
    docs = {0: TABLE, 1: EXPORT, 2: ["one line, of, four, users"], 3: [None, None], 4: [*EXPORT, "", *TABLE, *TABLE], 5: ["a\tuser\thost\tb", "1\tu1\th1\t2", *TABLE], None: TABLE}
    docs |= {k: [rng.choice(PIECES) for _ in range(rng.randrange(1, 25))] for k in range(10, 60)}
    docs |= {k: [EXPORT[0], *(rng.choice(PIECES) for _ in range(rng.randrange(1, 25)))] for k in range(60, 140)}
    rows = [(k, 2 * i + 5, v, 0) for k, lines in docs.items() for i, v in enumerate(lines)]
    rng.shuffle(rows)
    got = layout.spans(spark.createDataFrame(rows, "doc_id long, line_no long, line string, start int"), block=block).collect()
    for k, lines in docs.items():
        assert sorted((r.shape, r.start, r.end, r.label) for r in got if r.doc_id == k) == expected(lines), (k, lines)
    assert sum(map(len, map(expected, docs.values()))) == len(got) > 150


def test_no_lines(spark):
    assert layout.spans(spark.createDataFrame([], "doc_id long, line_no long, line string")).count() == 0
