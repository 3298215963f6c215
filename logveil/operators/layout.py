"""Delimited exports and printed tables found line by line, so that one huge text is many tasks.

``structural.delimited`` and ``structural.tables`` read a text as a whole. Here
a text is rows of lines. They are dealt by blocks of ``BLOCK`` lines and
shuffled once; what a block must know of the lines before it (its place, the
line above it, the columns of the ruler that still holds, the header of the
text) is carried over rows of blocks, of which there are fewer by that factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import values as V
from .masking import java
from .structural import column_label_column

BLOCK = 10_000  # lines
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_COLUMNS = "array<struct<a:int,b:int,label:string>>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACES}|{_SPACES}\z", "")


def _slice(text: Column, a: Column, b: Column) -> Column:
    """``text[a:b]`` in code points."""
    return text.substr(a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))


def _precise(value: Column) -> Column:
    return value.rlike(java(rf"\A(?:{V.FULL_IP}|{V.FULL_EMAIL})\z"))


def _trimmed(line: Column, a: Column, b: Column) -> tuple[Column, Column]:
    piece = _slice(line, a, b)
    left = a + F.length(piece) - F.length(F.regexp_replace(piece, r"\A[ \t]+", ""))
    return left, F.greatest(left, a + F.length(F.regexp_replace(piece, r"[ \t]+\z", "")))


def table_label_column(name: Column, beside: Column) -> Column:
    """``structural.table_label`` as an expression; ``beside``: the plain names of all columns."""
    plain = F.regexp_replace(F.lower(name), "[^a-z]", "")
    none = F.lit(None).cast("string")

    def told(words: list[str]) -> Column:
        return F.exists(beside, lambda s: s.rlike("|".join(words)))

    out = F.when(plain == "", none)
    for label, words in (("USER", V.PS_COLUMN_USER), ("HOST", V.PS_COLUMN_HOST)):
        out = out.when(plain.rlike("|".join(words)), label)
    out = out.when(~plain.isin(V.PS_COLUMN_CONTEXT), column_label_column(name))
    return out.when(told(V.PS_SOFTWARE_TABLE), none).when(told(V.PS_ACCOUNT_TABLE), "USER").when(told(V.PS_MACHINE_TABLE), "HOST")


def _ruled_columns(ruler: Column, above: Column) -> Column:
    """Where the columns of a table lie, by the dashes of its ruler, and what they hold, by the names above them."""
    runs = F.regexp_extract_all(ruler, F.lit("-+|[^-]+"), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    begins = F.aggregate(
        runs, start,
        lambda acc, run: F.struct((acc["at"] + F.length(run)).alias("at"), F.when(run.startswith("-"), F.concat(acc["begins"], F.array(acc["at"]))).otherwise(acc["begins"]).alias("begins")),
        lambda acc: acc["begins"],
    )
    places = F.transform(begins, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(begins, i + 1) - 1, F.lit(10**9)).alias("b")))
    names = F.transform(places, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), _strip(_slice(above, p["a"], p["b"])).alias("name")))
    beside = F.transform(names, lambda n: F.regexp_replace(F.lower(n["name"]), "[^a-z]", ""))
    labelled = F.transform(names, lambda n: F.struct(n["a"].alias("a"), n["b"].alias("b"), table_label_column(n["name"], beside).alias("label")))
    return F.filter(labelled, lambda c: c["label"].isNotNull()).cast(_COLUMNS)


def _table_cells(line: Column, columns: Column) -> Column:
    def cell(c: Column) -> Column:
        a, b = _trimmed(line, c["a"], F.least(c["b"], F.length(line)))
        # a value wider than its column is taken whole
        wide = b + F.length(F.regexp_extract(_slice(line, b, F.length(line)), r"\A[^ \t]*", 0))
        return F.struct((a - F.length(F.regexp_extract(_slice(line, F.lit(0), a), r"[^ \t]*\z", 0))).alias("a"), wide.alias("b"), c["label"].alias("label"))

    cells = F.transform(F.filter(columns, lambda c: c["a"] < F.length(line)), cell)
    return F.filter(cells, lambda c: _slice(line, c["a"], c["b"]).rlike("[A-Za-z0-9]") & ~_precise(_slice(line, c["a"], c["b"]))).cast(_COLUMNS)


def _cells(line: Column, delimiter: Column) -> Column:
    """``structural.cells`` as an expression: the parts of the line with a delimiter before it, each with its own, and where they lie."""

    def parts(d: str) -> Column:
        return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f'{d}(?:"(?:[^"]|"")*+(?:"[^{d}]*)?|[^{d}]*)'), 0)

    both = F.when(delimiter == ",", parts(",")).otherwise(parts("\t"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("cells"))

    def add(acc: Column, part: Column) -> Column:
        body = F.length(F.regexp_extract(part, r'\A."((?:[^"]|"")*+)', 1))
        quoted = part.substr(2, 1) == '"'
        a = acc["at"] + quoted.cast("int")
        b = F.when(quoted, a + body).otherwise(acc["at"] + F.length(part) - 1)
        return F.struct((acc["at"] + F.length(part)).alias("at"), F.concat(acc["cells"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("cells"))

    return F.aggregate(both, start, add, lambda acc: acc["cells"])


def _header(head: Column) -> tuple[Column, Column]:
    """The delimiter and the labels of a convincing header; no labels for any other line."""

    def count(d: str) -> Column:
        return F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))

    delimiter = F.when(count(",") >= count("\t"), ",").otherwise("\t")
    names = F.transform(_cells(head, delimiter), lambda c: _strip(_slice(head, c["a"], c["b"])))
    likely = F.size(F.filter(names, lambda n: n.rlike(java(V.HEADERISH))))
    labels = F.transform(names, lambda n: column_label_column(n))
    good = (F.greatest(count(","), count("\t")) >= 3) & ~_strip(head).rlike(r"\A[{\[]") & (likely >= F.lit(0.8) * F.size(names)) & F.exists(labels, lambda v: v.isNotNull())
    return delimiter, F.when(good, labels)


def _delimited_cells(line: Column, delimiter: Column, labels: Column) -> Column:
    def cell(c: Column, i: Column) -> Column:
        a, b = _trimmed(line, c["a"], c["b"])
        return F.struct(a.alias("a"), b.alias("b"), F.get(labels, i).alias("label"))

    cells = F.transform(_cells(line, delimiter), cell)
    return F.filter(cells, lambda c: c["label"].isNotNull() & (c["a"] < c["b"]) & ~_precise(_slice(line, c["a"], c["b"]))).cast(_COLUMNS)


def spans(lines: DataFrame, id_col: str = "doc_id", line_col: str = "line_no", text_col: str = "line", block: int = BLOCK) -> DataFrame:
    """``<id_col>, <line_col>, shape, start, end, label``: cells of delimited exports and of printed tables under sensitive names, in code points of the text that the lines make with a newline between them.

    Lines are in the order of their number, which no two lines of a text share
    (numbers may have gaps); a null line is empty, a null text id one text of
    its own. No lines give no rows; other columns are ignored. The spans are
    those of ``structural.delimited`` and ``structural.tables``.
    """
    key = F.struct(F.col(id_col).alias("id"), F.expr(f"`{line_col}` div {block}").alias("block"))
    texts = lines.select(key.alias("key"), F.col(line_col).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ended = F.regexp_replace("text", r"\r+\z", "").alias("line")
    size = (F.length("text") + 1).cast("long").alias("size")
    rows = texts.select("key", "n", ended, size)
    # dealt with the columns that all readers need, so that one shuffle serves them
    dealt = texts.repartition("key").select("key", "n", ended, size)
    earlier = Window.partitionBy("key.id").orderBy("key.block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key.id")

    blocks = rows.groupBy("key").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("lines"), F.min("n").alias("first_n"), F.min_by("line", "n").alias("first_line"), F.max_by("line", "n").alias("last_line")
    )
    head = F.min_by("first_line", "first_n").over(whole)
    facts = blocks.select(
        "key", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.last("last_line").over(earlier).alias("line_before"),
        F.min("first_n").over(whole).alias("head_n"), F.when(F.sum("lines").over(whole) > 1, head).alias("head"),
    )
    delimiter, labels = _header(F.col("head"))
    facts = facts.select("key", "before", "line_before", "head_n", delimiter.alias("delimiter"), labels.alias("labels"))

    inner = Window.partitionBy("key").orderBy("n")
    ruled = F.col("line").rlike(java(V.PS_RULER))
    placed = dealt.join(facts.hint("merge"), "key").select(
        "key", "n", "line", "delimiter", "labels", "head_n",
        (F.col("before") + F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("place"),
        F.coalesce(F.lag("line").over(inner), F.col("line_before"), F.lit("")).alias("above"), ruled.alias("ruled"),
    )
    nothing = F.array().cast(_COLUMNS)
    # a ruler under a line begins a table, any other ruler and an empty line end one
    begun = F.when(F.col("ruled") & (_strip(F.col("above")) != ""), _ruled_columns(F.col("line"), F.col("above"))).when(F.col("ruled") | (_strip(F.col("line")) == ""), nothing)
    placed = placed.withColumn("begun", begun)
    kept = placed.where("begun is not null").groupBy("key").agg(F.max_by("begun", "n").alias("left"))
    carried = blocks.select("key").join(kept, "key", "left").select("key", F.last("left", ignorenulls=True).over(earlier).alias("carried"))
    columns = F.when(~F.col("ruled"), F.coalesce(F.last("begun", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")))
    known = placed.join(carried.hint("merge"), "key").withColumn("columns", columns)

    line = F.col("line")
    in_table = F.when(F.size("columns") > 0, _table_cells(line, F.col("columns")))
    in_export = F.when(F.col("labels").isNotNull() & (F.col("n") > F.col("head_n")) & (_strip(line) != ""), _delimited_cells(line, F.col("delimiter"), F.col("labels")))

    def shaped(cells: Column, shape: str) -> Column:
        return F.transform(F.coalesce(cells, nothing), lambda c: F.struct(F.lit(shape).alias("shape"), c["a"].alias("a"), c["b"].alias("b"), c["label"].alias("label")))

    found = known.select("key", "n", "place", F.explode(F.concat(shaped(in_export, "export"), shaped(in_table, "table"))).alias("c"))
    return found.select(
        F.col("key.id").alias(id_col), F.col("n").alias(line_col), "c.shape", (F.col("place") + F.col("c.a")).alias("start"), (F.col("place") + F.col("c.b")).alias("end"), "c.label"
    )
