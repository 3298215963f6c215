"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.accept import veto_column
from ..operators import claims, lab, layout, leaks, ledger, masking, network, providers, structural, templates, vault, vaulting, verdicts
from ..operators.kernel import MaskConfig
from ..rules import registry
from ..rules import values as V
from ..session import shared_folder
from ..sources import audit, tail, xlsx
from ..sources import text as text_source
from ..streaming import conversations as conv
from ..streaming import ledger as ledger_stream
from ..streaming import vaults
from . import rendered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- values of single rules in the documents -----------------------------------------------------------------------

WORD = "[A-Za-z0-9_]"


def _documents_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        each = docs.select("doc_id", F.explode(masking.rule_values(F.col("text"), rule_id)).alias("value"))
        return each.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))

    return run


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse(d), i, 1) as int)
  else cast(substr('0246813579', cast(substr(reverse(d), i, 1) as int) + 1, 1) as int) end)) % 10 = 0"""


def _documents_sql(pattern: str, group: int, extra: str = "true") -> str:
    return f"""select doc_id, value, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, {rendered.quoted(pattern)}, {group})) as value from documents)
where value <> '' and ({extra}) group by doc_id, value"""


REGEX = {r[0]: r[4] for r in V.RULES}

for _rule, _extra in (("email", "true"), ("uuid", "true"), ("hex-blob", "true"), ("mac", "true"), ("ipv4", "not starts_with(value, '127.') and value <> '0.0.0.0'"), ("phone", "true")):
    _pattern, _group = rendered.SQL_PATTERNS.get(_rule, (REGEX[_rule], 0))
    query(f"detect_{_rule.replace('-', '_')}", _documents_sql(_pattern, _group, _extra))(_documents_rule(_rule))


@query(
    "detect_credit_card",
    f"""select doc_id, d as value, count(*) as n from (
  select doc_id, regexp_replace(value, '[ -]', '', 'g') as d from (
    select doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d[ -]?){{13,16}}\\b')) as value from documents))
where length(d) between 13 and 16 and {_LUHN} group by doc_id, d""",
)
def detect_credit_card(spark, sf_dir):
    """Card numbers by their digits; where a separator ends the match depends on what a letter is."""
    each = _documents_rule("credit-card")(spark, sf_dir)
    return each.groupBy("doc_id", F.regexp_replace("value", "[ -]", "").alias("value")).agg(F.sum("n").alias("n"))


query(
    "detect_secret_kv",
    f"""select doc_id, value, count(*) as n from (select doc_id, unnest(regexp_extract_all(text,
  {rendered.quoted("(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|auth|community|client[_-]?id)[\"']?\\s*[=:]\\s*[\"']?([^\\s\"',;]+)")}, 1)) as value from documents)
where value <> '' and value not similar to '/.*|@[{{(].*|-[A-Za-z].*' and not regexp_matches(lower(value), '^[(\\[{{]*(?:{"|".join(V.PS_VERBS)})-') group by doc_id, value""",
)(_documents_rule("secret-kv"))


# --- all rules over rendered lines ---------------------------------------------------------------------------------


def _rules_native(rows: DataFrame) -> DataFrame:
    """``event_id, rule_id, value``: the rule's pattern is a column from a table of 96 rows; lines are sorted by rule within their partition, so that each pattern is compiled once there."""
    spark = rows.sparkSession
    patterns = spark.createDataFrame([(r[0], *masking.rule(r[0])) for r in V.RULES], "rule_id string, label string, regex string, grp int")
    sorted_ = rows.join(F.broadcast(patterns), "rule_id").sortWithinPartitions("rule_id")
    each = sorted_.select("event_id", "rule_id", "label", F.explode(F.regexp_extract_all("line", F.col("regex"), F.col("grp"))).alias("value"))
    return each.where((F.col("value") != "") & veto_column(F.col("label"), F.col("value")).isNull()).drop("label")


def _rules_sql() -> str:
    cases = []
    for rule_id, _, _, _, regex in V.RULES:
        pattern, group = rendered.SQL_PATTERNS.get(rule_id, (regex, re.compile(regex).groups))
        cases.append(f"when {rendered.quoted(rule_id)} then regexp_extract_all(line, {rendered.quoted(pattern)}, {group})")
    return f"""select event_id, rule_id, count(*) as n, string_agg(value, '|' order by value) as found from (
  select event_id, rule_id, unnest(case rule_id {" ".join(cases)} end) as value from {rendered.lines_sql()}) where value <> '' group by event_id, rule_id"""


@query("rules_all_sources", _rules_sql())
def rules_all_sources(spark, sf_dir):
    """Each of the 96 rules over lines in the shape of its source, by Catalyst alone."""
    found = _rules_native(rendered.lines(spark, sf_dir))
    return found.groupBy("event_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("found"))


@query(
    "rules_by_source",
    f"""with f as ({_rules_sql()}), r(rule_id, source, label) as (values {", ".join(f"({rendered.quoted(r[0])}, {rendered.quoted(r[1])}, '{r[2]}')" for r in V.RULES)})
select source, label, count(distinct event_id) as n_lines, sum(n)::bigint as n_values from f join r using (rule_id) group by source, label""",
)
def rules_by_source(spark, sf_dir):
    """Found values by log source and label: the rule catalogue joined to the detections."""
    found = _rules_native(rendered.lines(spark, sf_dir))
    rules = registry.catalogue(spark).select("rule_id", "source", "label")
    return found.join(F.broadcast(rules), "rule_id").groupBy("source", "label").agg(F.countDistinct("event_id").alias("n_lines"), F.count(F.lit(1)).alias("n_values"))


_CATALOGUE_SQL = "(values " + ", ".join(f"({i}, {rendered.quoted(r[0])}, {rendered.quoted(r[1])}, '{r[2]}', '{r[3]}', {'true' if r[0] == 'mac' else 'false'})" for i, r in enumerate(V.RULES)) + ") t(priority, rule_id, source, label, category, modified)"


def _lines_by_rule(spark, sf_dir) -> DataFrame:
    return rendered.lines(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("rule_catalogue", f"select t.*, n_lines from {_CATALOGUE_SQL} join (select rule_id, count(*) as n_lines from {rendered.lines_sql()} group by 1) using (rule_id)")
def rule_catalogue(spark, sf_dir):
    """The catalogue with one rule overridden, and how many lines each rule's shape has."""
    rules = registry.catalogue(spark, {"mac": r"\b[0-9a-f]{12}\b", "uuid": "("}).select("priority", "rule_id", "source", "label", "category", "modified")
    return rules.join(_lines_by_rule(spark, sf_dir), "rule_id").select("priority", "rule_id", "source", "label", "category", "modified", "n_lines")


@query("rule_search", f"select rule_id, source, n_lines from {_CATALOGUE_SQL} join (select rule_id, count(*) as n_lines from {rendered.lines_sql()} group by 1) using (rule_id) where source ilike '%sysmon%'")
def rule_search(spark, sf_dir):
    return registry.search_catalogue(registry.catalogue(spark), "Sysmon").join(_lines_by_rule(spark, sf_dir), "rule_id").select("rule_id", "source", "n_lines")


# --- accept, labels, columns ---------------------------------------------------------------------------------------

ACCEPT_CASES = [
    ("USER", "", "R1"), ("USER", "$cred", "R2"), ("SECRET", "@{a}", "R3"), ("SECRET", "ConvertTo-SecureString", "R4"), ("USER", "Administrator", "R5"), ("ASSET", "GitHub", "R6"),
    ("GROUP", "ab", "R7"), ("HOST", "\\srv", "R8"), ("USER", "S-1-5-18", "R9"), ("USER", "BUILTIN\\x1", "R10"), ("USER", "CORP\\Domain Admins", "R11"), ("USER", "C\\windows", "R12"),
    ("USER", "1000", "R13"), ("HOST", "github.com", "R14"), ("HOST", "8080", "R15"), ("HOST", "a.log", "R16"), ("HOST", "x.deviceEvidence", "R17"), ("IP", "127.0.0.1", "R18"),
    ("SECRET", "/home/x", "R19"), ("CC", "4111 1111 1111 1112", "R20"), ("CC", "4111 1111 1111 1111", None), ("USER", "pkim", None), ("HOST", "srv01.corp.lan", None), ("IP", "10.1.2.3", None),
    ("SECRET", "$ecret1", None), ("CUSTOM", "Administrator", None), ("HOST", "Corp.Local", None),
]


def _cases(spark, sf_dir, table: str, key: str, cases: list[tuple], names: str) -> DataFrame:
    """A table's rows, each with the case of its key modulo their number (``k``): a broadcast of as many rows as there are cases."""
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, {names}")
    return _table(spark, sf_dir, table).select(F.col(key)).join(F.broadcast(rows), F.col(key) % len(cases) == F.col("k"))


def _cases_sql(table: str, key: str, cases: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "null" if v is None else rendered.quoted(v) if isinstance(v, str) else str(v)

    return f"(select {table}.{key}, {'user_id, ' if table == 'events' else ''}cases.* from {table} join (values " + ", ".join(f"({k}, {', '.join(map(one, c))})" for k, c in enumerate(cases)) + f") cases(k, {names}) on {key} % {len(cases)} = k)"


@query("accept_rules", f"select event_id, label, value, veto from {_cases_sql('events', 'event_id', ACCEPT_CASES, 'label, value, veto')}")
def accept_rules(spark, sf_dir):
    """The vetoes R1 to R20, and values that pass, over all events."""
    rows = _cases(spark, sf_dir, "events", "event_id", [c[:2] for c in ACCEPT_CASES], "label string, value string")
    return rows.select("event_id", "label", "value", veto_column(F.col("label"), F.col("value")).alias("veto"))


@query(
    "resolve_labels",
    f"""with s as (select event_id % 97 as doc_id, 'v' || (user_id % 40) as value, (['HOST', 'USER', 'EMAIL', 'MINE'])[event_id % 4 + 1] as label, event_id as claim from events),
r(label, rank) as (values {", ".join(f"('{k}', {v})" for k, v in registry.LABEL_RANK.items())})
select doc_id, value, arg_min(s.label, coalesce(rank, 99)::bigint * 1000000000 + claim) as label from s left join r using (label) group by doc_id, value""",
)
def resolve_labels(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    label = F.element_at(F.array(*[F.lit(x) for x in ("HOST", "USER", "EMAIL", "MINE")]), (F.col("event_id") % 4 + 1).cast("int"))
    spans = e.select((F.col("event_id") % 97).alias("doc_id"), F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("value"), label.alias("label"), F.col("event_id").alias("claim"))
    return masking.resolve_labels(spans)


# --- places, numbering, rewriting, restoring -----------------------------------------------------------------------

MAILBOX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PLACES_SQL = f"""places as (
  select doc_id, m[i] as value, coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) as start
  from (select doc_id, regexp_split_to_array(text, '{MAILBOX}') as g, regexp_extract_all(text, '{MAILBOX}') as m from documents), unnest(range(1, len(m) + 1)) t(i))"""
_NUMBER_SQL = f"""{_PLACES_SQL}, numbered as (
  select doc_id, value, row_number() over (partition by doc_id order by max(start) desc) as n from places group by doc_id, value)"""


def _mail_places(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.inline(masking.places(F.col("text"), F.lit(MAILBOX)))).withColumn("label", F.lit("EMAIL"))


@query("span_places", f"with {_PLACES_SQL} select doc_id, value, start::bigint as start from places")
def span_places(spark, sf_dir):
    return _mail_places(spark, sf_dir).select("doc_id", "value", F.col("start").cast("long").alias("start"))


@query("number_placeholders", f"with {_NUMBER_SQL} select doc_id, value, n + 5 as n, '[EMAIL_' || (n + 5) || ']' as placeholder from numbered")
def number_placeholders(spark, sf_dir):
    """Numbers continue a floor of five."""
    floors = spark.createDataFrame([("EMAIL", 5)], "label string, n int")
    return masking.number(_mail_places(spark, sf_dir), floors=floors).select("doc_id", "value", "n", "placeholder")


def _mail_masked(spark, sf_dir) -> DataFrame:
    places = _mail_places(spark, sf_dir)
    spans = places.join(masking.number(places), ["doc_id", "label", "value"])
    each = spans.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.length("value")).alias("end"), "placeholder"))).alias("s"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("placeholder", "value")))).alias("mapping"),
    )  # the spans of one document
    return _table(spark, sf_dir, "documents").join(each, "doc_id").select("doc_id", "text", "mapping", masking.rewrite(F.col("text"), F.col("s")).alias("masked"))


@query("rewrite_text", f"with {_NUMBER_SQL} select doc_id, list_reduce(list_prepend(text, list(value order by length(value) desc, value)), lambda a, v: replace(a, v, '[EMAIL_' || list_extract(list(n order by length(value) desc, value), list_position(list(value order by length(value) desc, value), v)) || ']')) as masked from numbered join documents using (doc_id) group by doc_id, text")
def rewrite_text(spark, sf_dir):
    return _mail_masked(spark, sf_dir).select("doc_id", "masked")


@query("unmask_round_trip", f"select doc_id, text as restored from documents where regexp_matches(text, '{MAILBOX}')")
def unmask_round_trip(spark, sf_dir):
    return _mail_masked(spark, sf_dir).select("doc_id", masking.unmask(F.col("masked"), F.col("mapping")).alias("restored"))


@query(
    "spread_values",
    r"""with t as (select event_id as doc_id, regexp_replace(unnest(regexp_extract_all(line, '[A-Za-z0-9_][A-Za-z0-9._\-@$]*')), '[.\-@$]+$', '') as value from """
    + rendered.lines_sql()
    + """) select doc_id, value, 'USER' as label, count(*) as n from t join (select event_id as doc_id, 'user' || user_id as value from events) using (doc_id, value) group by doc_id, value""",
)
def spread_values(spark, sf_dir):
    """Occurrences of each line's user as a token, by an equi-join."""
    rows = rendered.lines(spark, sf_dir)
    known = rows.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("user"), "user_id").alias("value"), F.lit("USER").alias("label"))
    return masking.spread(rows.withColumnRenamed("event_id", "doc_id"), known, text_col="line").select("doc_id", "value", "label", "n")


# --- the composite -------------------------------------------------------------------------------------------------


@query("mask_documents", "select doc_id, true as restored, 0::bigint as left_over, true as numbered, true as apart from documents")
def mask_documents(spark, sf_dir):
    """All documents through all tiers, by what must hold of each.

    It can be restored; no mailbox, hardware address or UUID is left; the
    numbers of each label run from 1; spans are apart, in order, and cut out
    the values that they name.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    masked = masking.mask(docs, keep=("text",))
    back = masking.unmask(F.col("masked"), F.col("mapping"))
    left = F.size(F.regexp_extract_all("masked", F.lit("|".join(masking.java(REGEX[r]).removeprefix("(?dU)") for r in ("email", "mac", "uuid"))), F.lit(0)))
    keys = F.map_keys("mapping")
    labels = F.transform(keys, lambda k: F.regexp_extract(k, r"^\[([A-Z0-9]+)_", 1))
    numbers = F.transform(keys, lambda k: F.regexp_extract(k, r"_(\d+)\]$", 1).cast("int"))
    numbered = F.forall(F.array_distinct(labels), lambda a: F.array_sort(F.transform(F.filter(F.arrays_zip(labels.alias("a"), numbers.alias("n")), lambda z: z["a"] == a), lambda z: z["n"])) == F.sequence(F.lit(1), F.size(F.filter(labels, lambda x: x == a))))
    apart = F.forall(F.transform("spans", lambda s, i: (s["end"] > s["start"]) & ((i == 0) | (F.element_at("spans", F.greatest(i, F.lit(1)))["end"] <= s["start"]))), lambda x: x)
    cut = F.forall("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["value"])
    return masked.select("doc_id", (back == F.col("text")).alias("restored"), left.cast("long").alias("left_over"), numbered.alias("numbered"), (apart & cut).alias("apart"))


@query("mask_lines", f"select event_id, rule_id, masked, true as restored from {rendered.lines_sql()}")
def mask_lines(spark, sf_dir):
    """Rendered lines of all sources through all tiers: the whole masked text of each."""
    masked = masking.mask(rendered.lines(spark, sf_dir), id_col="event_id", text_col="line", keep=("rule_id", "line"))
    return masked.select("event_id", "rule_id", "masked", (masking.unmask(F.col("masked"), F.col("mapping")) == F.col("line")).alias("restored"))


@query("native_lines", f"select event_id, rule_id, masked from {rendered.lines_sql()}")
def native_lines(spark, sf_dir):
    """The same lines masked by Catalyst alone: candidate spans of all rules as rows, claims as interval selection, numbers, rewriting."""
    lines = rendered.lines(spark, sf_dir)
    masked = claims.mask(lines, id_col="event_id", text_col="line")
    return masked.join(lines.select("event_id", "rule_id"), "event_id").select("event_id", "rule_id", "masked")


@query("native_kept_lines", f"select event_id, kept as masked from {rendered.lines_sql()}")
def native_kept_lines(spark, sf_dir):
    return claims.mask(rendered.lines(spark, sf_dir), id_col="event_id", text_col="kept")


_TRIED = [("cards", "CUSTOM", r"\b\d{4} \d{4} \d{4} \d{4}\b"), ("mail_hosts", "CUSTOM", r"@([A-Za-z0-9.\-]+)")]
_TRIAL_SQL = f"""(
  select distinct 'cards' as proposal, doc_id, unnest(regexp_extract_all(text, '{_TRIED[0][2]}')) as value from documents union all
  select distinct 'mail_hosts', doc_id, unnest(regexp_extract_all(text, '{_TRIED[1][2]}', 1)) from documents)"""


@query("pattern_trial", f"select proposal, doc_id, value from {_TRIAL_SQL}")
def pattern_trial(spark, sf_dir):
    """What two proposed patterns mask in all documents that the rule for mailboxes doesn't."""
    return claims.trial(_table(spark, sf_dir, "documents"), _TRIED, rules=("email",))


@query("pattern_trial_ranked", f"select row_number() over (order by n_values, n_texts, proposal) as place, * from (select proposal, count(distinct value) as n_values, count(distinct doc_id) as n_texts from {_TRIAL_SQL} group by 1)")
def pattern_trial_ranked(spark, sf_dir):
    """The proposals by what else they mask."""
    return claims.side_effects(pattern_trial(spark, sf_dir)).select("place", "proposal", "n_values", "n_texts")


_ADDRESS = "concat('10.', user_id % 256, '.', event_id % 256, '.', event_id % 200 + 1)"
_NETWORKS = "select concat('10.', s_suppkey % 256, '.', s_suppkey * 7 % 256, '.0/24') as network from {t} union all select concat('10.', s_suppkey * 3 % 256, '.0.0/', 10 + s_suppkey % 7) from {t} union all select '10.0.0.0/8' from {t}"


@query(
    "network_of_address",
    f"""with n as (select network, 167772160 + split_part(network, '.', 2)::bigint * 65536 + split_part(network, '.', 3)::bigint * 256 as base, split_part(network, '/', 2)::bigint as bits from (select distinct network from ({_NETWORKS.format(t="supplier")}))),
u as (select min(network) as network, base >> (32 - bits)::int as key, bits from n group by all),
e as (select event_id, {_ADDRESS} as address, 167772160 + (user_id % 256) * 65536 + (event_id % 256) * 256 + event_id % 200 + 1 as ip from events)
select event_id, any_value(address) as address, arg_max(network, bits) as network from e join u on e.ip >> (32 - bits)::int = key group by event_id""",
)
def network_of_address(spark, sf_dir):
    """The narrowest network of each event's address, of networks that the suppliers have."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_ADDRESS).alias("address"))
    _table(spark, sf_dir, "supplier").createOrReplaceTempView("suppliers_of_networks")
    return network.longest_prefix(rows, spark.sql(_NETWORKS.format(t="suppliers_of_networks")).distinct())


@query("mask_kept_lines", f"select event_id, rule_id, kept as masked, 0 as n_spans from {rendered.lines_sql()}")
def mask_kept_lines(spark, sf_dir):
    """For each rule a line of nearly its shape that has nothing to mask."""
    masked = masking.mask(rendered.lines(spark, sf_dir), id_col="event_id", text_col="kept", keep=("rule_id",))
    return masked.select("event_id", "rule_id", "masked", F.size("spans").alias("n_spans"))


@query("entities_by_source")
def entities_by_source(spark, sf_dir):
    """Masked values by label, language and source of the documents."""
    docs = _table(spark, sf_dir, "documents")
    spans = masking.spans(masking.mask(docs.select("doc_id", "text")))
    return spans.join(docs.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source", "label").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("value").alias("n_values"))


_OPTION_LINE = "concat('Unit Zeta saw QX', lpad(cast(event_id % 10000 as string), 4, '0'), ' for user=user', user_id, ' and user=boss at 10.1.2.', event_id % 250 + 1, '; zeta host=kappa7 done')"


@query(
    "mask_options",
    """select event_id, 'Unit [CUSTOM_2] saw [CODEX_1] for user=' || case when user_id = 7 then 'user7' else '[USER_4]' end || ' and user=[USER_3] at 10.1.2.' || (event_id % 250 + 1) || '; [CUSTOM_1] host=kappa7 done' as masked,
  case when user_id = 7 then 4 else 5 end as n_spans from events""",
)
def mask_options(spark, sf_dir):
    """Lines under a custom term in two spellings, a custom pattern, a kept term, a known value and one category off."""
    config = MaskConfig(enabled=("identities", "secrets"), custom_terms=("zeta",), custom_patterns=({"label": "code-x", "regex": r"\b[A-Z]{2}\d{4}\b"},), keep_terms=("user7",), base_mapping={"[USER_3]": "boss"})
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_OPTION_LINE).alias("line"))
    return masking.mask(rows, config, id_col="event_id", text_col="line").select("event_id", "masked", F.size("spans").alias("n_spans"))


KEEP_LINES = "select event_id, 'SHA256=' || md5(event_id::varchar) || md5(user_id::varchar) || ' hash=' || md5(event_id::varchar) as line from events"


@query("keep_rules", f"select event_id, 'SHA256=' || md5(event_id::varchar) || md5(user_id::varchar) || ' hash=[HASH_1]' as masked from ({KEEP_LINES}) join events using (event_id)")
def keep_rules(spark, sf_dir):
    """A digest under a file-hash key stays, a bare one goes."""
    e = _table(spark, sf_dir, "events")
    a, b = F.md5(F.col("event_id").cast("string")), F.md5(F.col("user_id").cast("string"))
    rows = e.select("event_id", F.concat(F.lit("SHA256="), a, b, F.lit(" hash="), a).alias("line"))
    return masking.mask(rows, id_col="event_id", text_col="line").select("event_id", "masked")


_HEADERS = {"User Name": "USER", "deviceName": "HOST", "AD Domain": "DOMAIN", "Source IP": "HOST", "user count": None, "Status": None, "id": None, "Offense Source": "USER"}


@query("csv_columns", f"select n_nationkey as k, n_nationkey || ' ' || header as header, label from nation, (values {', '.join(f'({rendered.quoted(h)}, {rendered.quoted(v) if v else chr(110) + chr(117) + chr(108) + chr(108)})' for h, v in _HEADERS.items())}) t(header, label) where n_nationkey % 8 = list_position([{', '.join(map(rendered.quoted, _HEADERS))}], header) - 1")
def csv_columns(spark, sf_dir):
    """Labels of column names, by the operator that exports use."""
    headers = F.array(*map(F.lit, _HEADERS))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), F.get(headers, F.col("n_nationkey") % 8)).alias("header"))
    return rows.withColumn("label", structural.column_label_column(F.col("header")))


@query(
    "mask_csv_export",
    """select doc_id, 'id,user,device,count' || chr(10) || string_agg(c_custkey || ',[USER_' || k || '],[HOST_' || k || '],' || c_nationkey, chr(10) order by c_custkey) as masked
from (select c_custkey, c_nationkey, c_custkey // 50 as doc_id, row_number() over (partition by c_custkey // 50 order by c_custkey desc) as k from customer) group by doc_id""",
)
def mask_csv_export(spark, sf_dir):
    """Exports of up to fifty rows of all customers: cells under sensitive columns, numbered from the end."""
    c = _table(spark, sf_dir, "customer")
    # the cells' names are unlike the numbers of the columns beside them
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit("person"), "c_custkey"), F.concat(F.lit("box"), "c_custkey"), F.col("c_nationkey").cast("string"))
    # a group is one export, of at most fifty rows
    docs = c.select(F.expr("c_custkey div 50").alias("doc_id"), F.struct("c_custkey", row.alias("row")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    text = F.concat(F.lit("id,user,device,count\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"))
    return masking.mask(docs.select("doc_id", text.alias("text"))).select("doc_id", "masked")


@query(
    "export_lines",
    """with rows as (select c_custkey as k, length(c_custkey::varchar) as w, length(c_nationkey::varchar) as v from customer),
placed as (select k, w, 21 + coalesce(sum(3 * w + v + 13) over (order by k rows between unbounded preceding and 1 preceding), 0) as place from rows)
select k + 1 as line_no, 'export' as shape, (place + w + 1)::bigint as start, (place + 2 * w + 7)::bigint as "end", 'USER' as label from placed
union all select k + 1, 'export', (place + 2 * w + 8)::bigint, (place + 3 * w + 11)::bigint, 'HOST' from placed""",
)
def export_lines(spark, sf_dir):
    """All customers as lines of one export: where its sensitive cells lie, without the text in one place."""
    key = F.col("c_custkey").cast("string")
    row = F.concat_ws(",", key, F.concat(F.lit("person"), key), F.concat(F.lit("box"), key), F.col("c_nationkey").cast("string"))
    lines = _table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), (F.col("c_custkey") + 1).alias("line_no"), row.alias("line"))
    head = spark.range(1).select(F.lit(0), F.col("id"), F.lit("id,user,device,count"))
    return layout.spans(lines.union(head)).drop("doc_id")


@query(
    "table_lines",
    """with rows as (select c_mktsegment as segment, c_custkey as k, length(c_custkey::varchar) as w, length(c_nationkey::varchar) as v from customer),
placed as (select segment, k, w, 86 + coalesce(sum(37 + v) over (partition by segment order by k rows between unbounded preceding and 1 preceding), 0) as place from rows)
select segment, k + 2 as line_no, 'table' as shape, place::bigint as start, (place + w + 1)::bigint as "end", 'USER' as label from placed
union all select segment, k + 2, 'table', (place + 20)::bigint, (place + 23 + w)::bigint, 'HOST' from placed""",
)
def table_lines(spark, sf_dir):
    """The customers of each segment as lines of a printed table: where the cells under sensitive names lie."""
    key = F.col("c_custkey").cast("string")
    customers = _table(spark, sf_dir, "customer")
    row = F.concat(F.rpad(F.concat(F.lit("u"), key), 20, " "), F.rpad(F.concat(F.lit("box"), key), 16, " "), F.col("c_nationkey").cast("string"))
    lines = customers.select("c_mktsegment", (F.col("c_custkey") + 2).alias("line_no"), row.alias("line"))
    top = F.array(F.lit(f"{'SamAccountName':20}{'HostName':16}Number"), F.lit(f"{'-' * 18}  {'-' * 14}  {'-' * 6}"))
    heads = customers.select("c_mktsegment").distinct().select("c_mktsegment", F.posexplode(top))
    return layout.spans(lines.union(heads), "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


@query(
    "structural_shapes",
    """select s_suppkey as id, 'Get-ADUser -Identity ''[USER_2]'' -Server [HOST_3],[HOST_2]' || chr(10) || 'Name          Enabled DNSHostName' || chr(10) || '----          ------- -----------' || chr(10)
  || '[USER_1]' || repeat(' ', 10 - length(s_suppkey::varchar)) || 'True    [HOST_1]' || chr(10) || chr(10) || 'powershell -enc [ENCODED_1]' || chr(10) as masked from supplier""",
)
def structural_shapes(spark, sf_dir):
    """PowerShell parameters, tables and an encoded command over the suppliers."""
    import base64

    blob = base64.b64encode("Invoke-Command -ComputerName DC01 -Credential ACME7\\svc".encode("utf-16-le")).decode()
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    text = F.concat(
        F.lit("Get-ADUser -Identity '"), "name", F.lit("' -Server DC01,DC02\nName          Enabled DNSHostName\n----          ------- -----------\n"), F.rpad(F.concat(F.lit("acct"), F.col("id").cast("string")), 14, " "),
        F.lit("True    ws"), F.col("id").cast("string"), F.lit(f".corp.lan\n\npowershell -enc {blob}\n"),
    )
    return masking.mask(s.select("id", text.alias("text")), id_col="id").select("id", "masked")


# --- residue -------------------------------------------------------------------------------------------------------

_LEAK_KINDS = f"""hits as (
  select doc_id, 3 as detector, 'ip_address' as type, 'high' as severity, unnest(regexp_extract_all(text, {rendered.quoted(leaks.IPV4)})) as value from documents
  union all select doc_id, 4, 'email', 'high', unnest(regexp_extract_all(text, {rendered.quoted(leaks.MAILBOX)})) from documents
  union all select doc_id, 5, 'secret_like', 'medium', unnest(regexp_extract_all(text, {rendered.quoted(leaks.HEX)})) from documents),
counted as (select doc_id, type, severity, value, count(*) as n from hits where not (type = 'ip_address' and (starts_with(value, '127.') or value = '0.0.0.0')) group by all)"""


@query("leak_kinds", f"with {_LEAK_KINDS} select doc_id, type, severity, lower(value) as value, arg_max(n, value) as count from counted group by doc_id, type, severity, lower(value)")
def leak_kinds(spark, sf_dir):
    """Addresses, mailboxes and hex left in unmasked documents."""
    found = leaks.scan(_table(spark, sf_dir, "documents"), text_col="text")
    return found.where("type in ('ip_address', 'email') or (type = 'secret_like' and value rlike '^[A-Fa-f0-9]{32,}$')").select("doc_id", "type", "severity", F.lower("value").alias("value"), "count")


@query("leak_findings")
def leak_findings(spark, sf_dir):
    """All seven detectors over masked documents with their mappings."""
    masked = masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks.scan(masked, custom_terms=["license"], keep_terms=["example"], mapping_col="mapping")


@query(
    "entropy_tokens",
    r"""with t as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9+/_\-]{20,}\b'))) as token from documents)
select doc_id, token, round(list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)) * log2((length(token) - length(replace(token, c, ''))) / length(token)))), 6) as bits
from t where regexp_matches(token, '[0-9]') and regexp_matches(token, '[A-Za-z]')""",
)
def entropy_tokens(spark, sf_dir):
    """Entropy of long tokens with digits and letters."""
    docs = _table(spark, sf_dir, "documents")
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z0-9+/_\-]{20,}\b"), F.lit(0)))
    each = docs.select("doc_id", F.explode(tokens).alias("token")).where("token rlike '[0-9]' and token rlike '[A-Za-z]'")
    return each.select("doc_id", "token", F.round(leaks.entropy(F.col("token")), 6).alias("bits"))


_DETECTED = {
    "custom_term": ("high", "'Acme'"),
    "email": ("high", "concat('user', user_id, '@corp.io')"),
    "ip_address": ("high", "concat('10.9.', user_id % 256, '.', event_id % 250)"),
    "known_value": ("high", "concat('user', user_id)"),
    "host_like": ("medium", "concat('SRV-', user_id % 50 + 100)"),
    "secret_like": ("medium", "md5(cast(event_id as string))"),
    "secret_like ": ("medium", "concat('Abcdefgh1234567890Zz', event_id % 10)"),
}


@query(
    "leak_detectors",
    " union all ".join(f"select event_id, {k} as rank, '{t.strip()}' as type, '{severity}' as severity, {value} as value, {3 if t == 'known_value' else 1}::bigint as count from events" for k, (t, (severity, value)) in enumerate(_DETECTED.items(), 1)),
)
def leak_detectors(spark, sf_dir):
    """All seven detectors on one line for each event, a value that two of them find once, in order."""
    parts = [v for _, v in _DETECTED.values()]
    line = f"concat('seen ', {parts[3]}, ' at ', {parts[2]}, ' by ', {parts[1]}, ' hex ', {parts[5]}, ' token ', {parts[6]}, ' asset ', {parts[4]}, ' of Acme and ', {parts[3]}, '; UTF-8 127.0.0.1')"
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(line).alias("masked"), F.expr(f"map('[USER_1]', {parts[3]})").alias("mapping"))
    return leaks.scan(rows, custom_terms=["Acme", "xy"], id_col="event_id", mapping_col="mapping").select("event_id", "rank", "type", "severity", "value", "count")


_ASSET_SQL = r"(?:^|[^%\w.\-/\\])([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)\b"


@query(
    "leak_assets",
    f"""with a as (select event_id, line, unnest(regexp_extract_all(line, {rendered.quoted(_ASSET_SQL)}, 1)) as value from {rendered.lines_sql()})
select event_id as doc_id, any_value(value) as value, 'medium' as severity, ((length(any_value(line)) - length(replace(any_value(line), any_value(value), ''))) / length(any_value(value)))::bigint as count
from a where regexp_matches(value, '[0-9]') and lower(value) not in ({", ".join(map(rendered.quoted, leaks.SAFE))}) and not regexp_matches(lower(value), '^({"|".join(leaks.SAFE_PREFIXES)})') group by event_id, lower(value)""",
)
def leak_assets(spark, sf_dir):
    """Names of assets in the lines of all shapes."""
    rows = rendered.lines(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.col("line").alias("masked"))
    return leaks.scan(rows, enabled=("network",)).where("type = 'host_like'").select("doc_id", "value", "severity", "count")


@query(
    "leak_known_values",
    f"""select event_id as doc_id, 'user' || user_id as value, n as count, 'high' as severity from (
  select event_id, user_id, len(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])user' || user_id || '(?:[^A-Za-z0-9_]|$)'))::bigint as n from {rendered.lines_sql()}) where n > 0""",
)
def leak_known_values(spark, sf_dir):
    """Values masked elsewhere that are still there, in the lines of all shapes."""
    rows = rendered.lines(spark, sf_dir)
    mapping = rows.select(F.col("event_id").alias("doc_id"), F.lit("[USER_1]").alias("placeholder"), F.concat(F.lit("user"), "user_id").alias("value"), F.lit(1).alias("ord"))
    found = leaks.scan(rows.select(F.col("event_id").alias("doc_id"), F.col("line").alias("masked")), mapping, enabled=())
    return found.select("doc_id", "value", "count", "severity")


# --- ledger --------------------------------------------------------------------------------------------------------

_AUDIT_SQL = """audit as (
  select conv_id * 1000 + turn as seq, '2024-0' || (conv_id % 3 + 1) || '-1' || (turn % 10) || 'T10:00:00+00:00' as time,
    (['anthropic', 'openai', 'ollama', 'azure', 'm365copilot', ''])[conv_id % 6 + 1] as provider, (['claude-x-opus', 'gpt-y-mini', 'llama', 'deploy1', 'copilot', 'mystery'])[conv_id % 6 + 1] as model,
    'c' || conv_id as conversation_id, text, turn % 5 <> 4 as ok, turn % 3 = 0 as exact from conversations),
entries as (
  select *, substr(time, 1, 7) as month, coalesce(nullif(provider, ''), 'unknown') as p,
    case when exact then 100 + turn_len else greatest(1, turn_len // 4) * (turn_len > 0)::int end as tokens_in,
    case when exact then 7 else greatest(1, (turn_len // 2) // 4) * (turn_len // 2 > 0)::int end as tokens_out, (not exact)::int as estimated
  from (select *, length(text) as turn_len from audit) where ok)"""
_RATE_SQL = """case when p in ('ollama', 'm365copilot') then [0.0, 0.0] when p = 'azure' then null when model = 'claude-x-opus' then [15.0, 75.0] when model = 'gpt-y-mini' then [0.25, 2.0] end"""


def _audit(spark, sf_dir) -> DataFrame:
    """Turns as requests: exact usage for every third, failures, providers with and without rates."""
    c = _table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")

    def pick(*names: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, names)), (F.col("conv_id") % len(names) + 1).cast("int"))

    usage = F.when(F.col("turn") % 3 == 0, F.struct((F.length("text") + 100).cast("long").alias("input_tokens"), F.lit(7).cast("long").alias("output_tokens"), F.lit("provider").alias("source")))
    return c.select(
        seq.alias("seq"),
        F.concat(F.lit("2024-0"), (F.col("conv_id") % 3 + 1).cast("string"), F.lit("-1"), (F.col("turn") % 10).cast("string"), F.lit("T10:00:00+00:00")).alias("time"),
        pick("anthropic", "openai", "ollama", "azure", "m365copilot", "").alias("provider"),
        pick("claude-x-opus", "gpt-y-mini", "llama", "deploy1", "copilot", "mystery").alias("model"),
        F.concat(F.lit("c"), "conv_id").alias("conversation_id"),
        F.lit(None).cast("string").alias("system"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
        F.expr("substring(text, 1, length(text) div 2)").alias("response"),
        (F.col("turn") % 5 != 4).alias("ok"),
        usage.alias("usage"),
    )


_BUCKET_SQL = f"with {_AUDIT_SQL} select p as provider, model, month, count(*) as requests, sum(tokens_in)::bigint as tokens_in, sum(tokens_out)::bigint as tokens_out, sum(estimated)::bigint as estimated from entries group by all"


@query("ledger_buckets", _BUCKET_SQL)
def ledger_buckets(spark, sf_dir):
    return ledger.buckets(_audit(spark, sf_dir))


@query(
    "ledger_summary",
    f"""with {_AUDIT_SQL}, priced as (select *, {_RATE_SQL} as r from entries)
select p as provider, count(*) filter (month = '2024-02') as requests_month, count(*) as requests_all, sum(tokens_in)::bigint as tokens_in_all, coalesce(sum(tokens_out) filter (month = '2024-02'), 0)::bigint as tokens_out_month,
  round(coalesce(sum(coalesce(tokens_in / 1e6 * r[1] + tokens_out / 1e6 * r[2], 0)), 0), 9) as cost_all, coalesce(string_agg(distinct model, ',' order by model) filter (r is null), '') as unpriced_all from priced group by p""",
)
def ledger_summary(spark, sf_dir):
    s = ledger.summary(_audit(spark, sf_dir), "2024-02")
    return s.select("provider", "requests_month", "requests_all", "tokens_in_all", "tokens_out_month", F.round("cost_all", 9).alias("cost_all"), "unpriced_all")


@query(
    "ledger_credits",
    f"""with {_AUDIT_SQL}, g(provider) as (values ('anthropic'), ('openai'), ('gemini'), ('ollama'), ('azure'), ('m365copilot')), c as (select p as provider, count(*) as n from entries group by 1)
select provider, coalesce(n, 0) as requests_all, case provider when 'ollama' then 'free' when 'm365copilot' then 'licensed' else 'metered' end as cost_model from g left join c using (provider)""",
)
def ledger_credits(spark, sf_dir):
    """Every provider, with noughts where nothing was sent."""
    registry_rows = spark.createDataFrame([(p, p) for p in ("anthropic", "openai", "gemini", "ollama", "azure", "m365copilot")], "provider string, label string")
    return ledger.credits(registry_rows, _audit(spark, sf_dir), "2024-02").select("provider", "requests_all", "cost_model")


@query(
    "ledger_conversations",
    f"""with {_AUDIT_SQL}, priced as (select *, {_RATE_SQL} as r from entries)
select conversation_id, p as provider, count(*) as requests, sum(tokens_in)::bigint as tokens_in, round(sum(coalesce(tokens_in / 1e6 * r[1] + tokens_out / 1e6 * r[2], 0)), 9) as cost, arg_min(time, seq) as started, arg_max(time, seq) as last, any_value(model) as models
from priced group by conversation_id, p""",
)
def ledger_conversations(spark, sf_dir):
    c = ledger.conversations(_audit(spark, sf_dir))
    return c.select("conversation_id", "provider", "requests", "tokens_in", F.round("cost", 9).alias("cost"), "started", "last", "models")


@query("ledger_rollup", f"with {_AUDIT_SQL} select p as provider, model, month, count(*) as requests, sum(tokens_in)::bigint as tokens_in from entries group by rollup(p, model, month)")
def ledger_rollup(spark, sf_dir):
    return ledger.entries(_audit(spark, sf_dir)).rollup("provider", "model", "month").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"))


@query("ledger_latest", f"with {_AUDIT_SQL} select seq, provider, model, conversation_id from audit where time >= '2024-02-11' and time < '2024-02-15T10:01' order by seq desc limit 200")
def ledger_latest(spark, sf_dir):
    """The last two hundred requests of a span of time."""
    rows = ledger.in_range(_audit(spark, sf_dir), "2024-02-11 00:00:00", "2024-02-15 10:00:00")
    return ledger.latest(rows).select("seq", "provider", "model", "conversation_id")


RATE_CASES = [("anthropic", "claude-x-opus", 15.0, "default"), ("openai", "gpt-z-nano", 0.05, "default"), ("openai", "o3-pro", 1.1, "default"), ("azure", "gpt-z", None, None), ("ollama", "x", 0.0, "free"), ("m365copilot", "x", 0.0, "licensed"), ("openai", " My-Model ", 2.0, "custom"), ("gemini", "gemini-flash-lite", 0.1, "default"), ("openai", "", None, None)]


@query("rate_lookup", f"select event_id, provider, model, rate_in::double as rate_in, rate_source from {_cases_sql('events', 'event_id', RATE_CASES, 'provider, model, rate_in, rate_source')}")
def rate_lookup(spark, sf_dir):
    """Rates of all events' models: defaults, a user's own, free and unknown ones."""
    rows = _cases(spark, sf_dir, "events", "event_id", [c[:2] for c in RATE_CASES], "provider string, model string").withColumns({"tokens_in": F.lit(1), "tokens_out": F.lit(1)})
    own = spark.createDataFrame([("my-model", 2.0, 4.0)], "model string, own_in double, own_out double")
    return ledger.priced(rows, own).select("event_id", "provider", "model", "rate_in", "rate_source")


@query("stream_ledger", _BUCKET_SQL)
def stream_ledger(spark, sf_dir):
    """The buckets from a stream of the log's lines."""
    folder = shared_folder(spark)
    _audit(spark, sf_dir).write.json(f"{folder}/log")
    stream = ledger_stream.running_buckets(ledger_stream.read_folder(spark, f"{folder}/log"))
    return ledger_stream.drain(stream, folder)


@query("tail_ledger", _BUCKET_SQL)
def tail_ledger(spark, sf_dir):
    """The buckets from files that are followed in byte ranges."""
    spark.dataSource.register(tail.LogTail)
    folder = shared_folder(spark)
    _audit(spark, sf_dir).write.json(f"{folder}/log")
    lines = spark.readStream.format("log_tail").option("path", f"{folder}/log/part-").option("bytesPerPartition", 1 << 20).load().select("value")
    return ledger_stream.drain(ledger_stream.running_buckets(audit.parse(lines)), folder)


# --- vault ---------------------------------------------------------------------------------------------------------

_SEEN_SQL = """seen as (
  select 'c' || conv_id as incident_id, '2024-01-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || 'T00:00:00' as time, '[USER_' || (turn % 7 + conv_id % 5) || ']' as placeholder,
    'value' || (turn % 7 + conv_id % 5) as value, conv_id * 1000 + turn as ord from conversations)"""


def _vault(spark, sf_dir) -> tuple[vault.Vault, DataFrame]:
    """Conversations as incidents, in two recordings, with verdicts."""
    c = _table(spark, sf_dir, "conversations")
    number = (F.col("turn") % 7 + F.col("conv_id") % 5).cast("string")
    seen = c.select(
        F.concat(F.lit("c"), "conv_id").alias("incident_id"), F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00")).alias("time"),
        F.concat(F.lit("[USER_"), number, F.lit("]")).alias("placeholder"), F.concat(F.lit("value"), number).alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )
    first, new_first = vault.record(vault.empty(spark), seen.where("ord < 50000"))
    both, new_second = vault.record(first, seen.where("ord >= 50000"))
    judged = c.where("conv_id % 2 = 0").select(F.concat(F.lit("c"), "conv_id").alias("incident_id"), F.when(F.col("conv_id") % 4 == 0, "true_positive").otherwise("false_positive").alias("verdict"), F.lit("high").alias("severity")).distinct()
    return vault.set_verdicts(both, judged), new_first.unionByName(new_second)


@query("vault_entities", f"with {_SEEN_SQL} select placeholder, 'USER' as label, value, arg_min(time, ord) as first_seen, arg_max(time, ord) as last_seen, count(distinct incident_id) as incident_count from seen group by placeholder, value")
def vault_entities(spark, sf_dir):
    return vault.history(_vault(spark, sf_dir)[0]).select("placeholder", "label", "value", "first_seen", "last_seen", "incident_count")


@query("vault_new", f"with {_SEEN_SQL} select incident_id, count(*) as n_new from (select placeholder, arg_min(incident_id, ord) as incident_id from seen group by placeholder) group by incident_id")
def vault_new(spark, sf_dir):
    return _vault(spark, sf_dir)[1]


@query("vault_stats", f"with {_SEEN_SQL} select 'USER' as label, count(distinct placeholder) as entities, 0::bigint as incidents from seen union all select '', count(distinct placeholder), count(distinct incident_id) from seen")
def vault_stats(spark, sf_dir):
    return vault.stats(_vault(spark, sf_dir)[0]).fillna({"label": "", "incidents": 0})


@query(
    "vault_context",
    f"""with {_SEEN_SQL}, links as (select distinct placeholder, incident_id from seen), e as (select placeholder, arg_min(time, ord) as f, arg_max(time, ord) as l from seen group by placeholder),
v as (select placeholder, case when substr(incident_id, 2)::int % 4 = 0 then 'true_positive' when substr(incident_id, 2)::int % 2 = 0 then 'false_positive' end as verdict from links),
o as (select placeholder, verdict, count(*) as c, min(k) as k from (select v.placeholder, v.verdict, s.k from v join (select placeholder, incident_id, min(ord) as k from seen group by all) s on v.placeholder = s.placeholder
  and v.verdict = case when substr(s.incident_id, 2)::int % 4 = 0 then 'true_positive' when substr(s.incident_id, 2)::int % 2 = 0 then 'false_positive' end) group by all),
c as (select v.placeholder, verdict, count(*) as c, any_value(k) as k from v join o using (placeholder, verdict) where verdict is not null group by all),
t as (select placeholder, string_agg(verdict || ' ×' || c, ', ' order by c desc, k) as said from c group by placeholder),
r as (select placeholder, count(*) as n from links group by placeholder)
select row_number() over (order by n desc, placeholder) as rank, placeholder, placeholder || ': seen in ' || n || ' prior ' || case when n = 1 then 'analysis' else 'analyses' end || ' on this system (first ' || substr(f, 1, 10) || ', last ' || substr(l, 1, 10) || coalesce('; verdicts: ' || said, '') || ')' as line
from r join e using (placeholder) left join t using (placeholder) order by n desc, placeholder limit 8""",
)
def vault_context(spark, sf_dir):
    v, _ = _vault(spark, sf_dir)
    return vault.context_lines(v, v.entities).withColumn("rank", F.col("rank").cast("long"))


@query("vault_forget", f"with {_SEEN_SQL}, k as (select distinct placeholder from seen) select (select count(*) from k where placeholder not in ('[USER_1]', '[USER_2]')) as entities, (select max(regexp_extract(placeholder, '(\\d+)', 1)::int) from k) as counter")
def vault_forget(spark, sf_dir):
    """Two entities go, the counter stays."""
    v = vault.forget_terms(_vault(spark, sf_dir)[0], ["VALUE1", "value2"])
    return v.entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(v.counters.agg(F.max("n").alias("counter")))  # one row by one row


@query("vault_ordered")
def vault_ordered(spark, sf_dir):
    """The incidents of one vault after each other with one numbering."""
    c = _table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit("c"), "conv_id").alias("incident_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return vaulting.vaulted(rows).select("incident_id", "ord", "masked", F.size("mapping").alias("n_values"))


@query(
    "vault_numbering",
    """with r as (select g, row_number() over (order by m) as k from (select s_suppkey % 7 as g, min(s_suppkey) as m from supplier group by 1))
select 'i' || s_suppkey as incident_id, s_suppkey as ord, 'login user=[USER_' || k || '] ok' as masked from supplier join r on s_suppkey % 7 = g""",
)
def vault_numbering(spark, sf_dir):
    """One vault over the suppliers' incidents: a name keeps the number that it got when it came first."""
    key = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), key).alias("incident_id"), key.cast("long").alias("ord"), F.concat(F.lit("login user=acct"), (key % 7).cast("string"), F.lit(" ok")).alias("text"))
    return vaulting.vaulted(rows).select("incident_id", "ord", "masked")


_TURNS_SQL = """with t as (select user_id as conv_id, event_id as turn, event_id % 5 as g from events), r as (select conv_id, g, row_number() over (partition by conv_id order by m) as k from (select conv_id, g, min(turn) as m from t group by all))
select conv_id, turn, 'user=[USER_' || k || '] ok' as masked from t join r using (conv_id, g)"""


def _event_turns(spark, sf_dir) -> DataFrame:
    """Events as turns, each user's as one conversation."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("conv_id"), F.col("event_id").cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("user=acct"), (F.col("event_id") % 5).cast("string"), F.lit(" ok")).alias("text"))


def _streamed(spark, turns: DataFrame) -> DataFrame:
    folder = shared_folder(spark)
    turns.write.parquet(f"{folder}/turns")
    return ledger_stream.drain(conv.stream(spark.readStream.schema(turns.schema).parquet(f"{folder}/turns")), folder, "append")


@query(
    "vault_stream",
    """with t as (select s_suppkey % 3 as v, s_suppkey as ord, s_suppkey % 7 as g from supplier), r as (select v, g, row_number() over (partition by v order by m) as k from (select v, g, min(ord) as m from t group by all))
select 'team' || v as vault, 'i' || ord as incident_id, 'login user=[USER_' || k || '] ok' as masked, false as late from t join r using (v, g)""",
)
def vault_stream(spark, sf_dir):
    """Three vaults over the suppliers' incidents as a stream with keyed maps."""
    key = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("team"), (key % 3).cast("string")).alias("vault"), F.concat(F.lit("i"), key).alias("incident_id"), key.cast("long").alias("ord"),
        F.concat(F.lit("login user=acct"), (key % 7).cast("string"), F.lit(" ok")).alias("text"),
    )
    folder = shared_folder(spark)
    rows.coalesce(1).write.parquet(f"{folder}/incidents")  # one file is one batch, which is masked in the order of ord
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/incidents")
    return ledger_stream.drain(vaults.masked(stream), folder, "append").select("vault", "incident_id", "masked", "late")


@query("conversation_numbering", _TURNS_SQL)
def conversation_numbering(spark, sf_dir):
    """Numbers of a conversation's names, in the order of its turns."""
    return conv.batch(_event_turns(spark, sf_dir)).select("conv_id", "turn", "masked")


@query("conversation_stream_numbering", _TURNS_SQL)
def conversation_stream_numbering(spark, sf_dir):
    """The same from a stream."""
    return _streamed(spark, _event_turns(spark, sf_dir)).select("conv_id", "turn", "masked")


@query("conversation_masking")
def conversation_masking(spark, sf_dir):
    """Turn by turn, each conversation with its own mapping."""
    return conv.batch(_table(spark, sf_dir, "conversations"))


@query("conversation_stream")
def conversation_stream(spark, sf_dir):
    """The same from a stream, the mapping kept as state."""
    return _streamed(spark, _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# --- templates, verdicts, workbench, text --------------------------------------------------------------------------

def _template_sql() -> str:
    from ..rules.template_values import SIGNALS

    parts = []
    for k, (name, signals) in enumerate(SIGNALS.items()):
        hit = " + ".join(f"{w} * regexp_matches(line, {rendered.quoted('(?i)' + p)})::int" for w, p in signals)
        fired = " + ".join(f"regexp_matches(line, {rendered.quoted('(?i)' + p)})::int" for _, p in signals)
        parts.append(f"select event_id as doc_id, {k} as ord, '{name}' as template_id, ({hit}) as hit, ({fired}) as signals_fired, {sum(w for w, _ in signals)} as total from l")
    return f"""with l as materialized {rendered.lines_sql()}, s as ({" union all ".join(parts)}),
r as (select *, row_number() over (partition by doc_id order by hit / total desc, signals_fired desc, ord) as rank from s where hit > 0 and hit / total >= 0.12)
select doc_id, rank, template_id, round(hit / total, 6) as score, signals_fired from r where rank <= 3"""


@query("template_scores", _template_sql())
def template_scores(spark, sf_dir):
    rows = rendered.lines(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.col("line").alias("text"))
    got = templates.suggest(rows)
    totals = {t: sum(w for w, _ in s) for t, s in templates.SIGNALS.items()}
    total = F.create_map(*[F.lit(x) for p in totals.items() for x in p])[F.col("template_id")]
    # scores have three digits; as shares of the weights they are exact again
    return got.select("doc_id", F.col("rank").cast("long").alias("rank"), "template_id", F.round(F.round(F.col("score") * total) / total, 6).alias("score"), "signals_fired")


@query("template_search", f"select event_id, template_id from events join (values " + ", ".join(f"({k}, '{t[0]}')" for k, t in enumerate(templates.TEMPLATES) if all(w in " ".join(t[1:]).lower() for w in ("access", "ta00"))) + f") t(k, template_id) on event_id % {len(templates.TEMPLATES)} = k")
def template_search(spark, sf_dir):
    """Of the events' templates those that have the words of a search."""
    found = templates.search(templates.library(spark), "Access TA00").select("ord", "template_id")
    return _table(spark, sf_dir, "events").join(F.broadcast(found), F.col("event_id") % len(templates.TEMPLATES) == F.col("ord")).select("event_id", "template_id")


@query("verdict_fields", "select event_id, (['true_positive', 'false_positive', 'inconclusive'])[event_id % 3 + 1] as verdict, (['high', ''])[event_id % 2 + 1] as severity, 'seen user' || user_id as summary, 1 as n_iocs, 'ip' as ioc_type, '10.0.0.1' as ioc, 'Some prose.' as prose from events")
def verdict_fields(spark, sf_dir):
    """Verdicts of rendered answers, restored."""
    e = _table(spark, sf_dir, "events")

    def pick(*names: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))

    answer = F.concat(
        F.lit('Some prose.\n```json\n{"verdict": "'), pick("True Positive", "false-positive", "odd"), F.lit('", "severity": "'), pick("HIGH", "none"),
        F.lit('", "summary": "seen [USER_1]", "iocs": [{"type": "IP", "value": "[IP_1]"}, {"value": ""}]}\n```'),
    )
    mapping = F.create_map(F.lit("[USER_1]"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.lit("[IP_1]"), F.lit("10.0.0.1"))
    rows = verdicts.parse(e.select("event_id", answer.alias("text"), mapping.alias("mapping")), "event_id", "text", "mapping")
    v = F.col("verdict")
    return rows.select("event_id", v["verdict"].alias("verdict"), v["severity"].alias("severity"), v["summary"].alias("summary"), F.size(v["iocs"]).alias("n_iocs"), v["iocs"][0]["type"].alias("ioc_type"), v["iocs"][0]["value"].alias("ioc"), "prose")


DIAGNOSES = [("user=pkim{n} x", "pkim{n}", "already_masked"), ("sha256={x}{x}", "{x}{x}", "protected"), ("user=root", "root", "rejected"), ("thing QQ{n} there", "QQ{n}", "no_match")]


@query(
    "diagnose",
    "select event_id, (['already_masked', 'protected', 'rejected', 'no_match'])[event_id % 4 + 1] as verdict from events",
)
def diagnose(spark, sf_dir):
    """Why a value of a line is masked or isn't, for four kinds of lines over the events."""
    shapes = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(DIAGNOSES)], "k int, line string, value string")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id").join(F.broadcast(shapes), F.col("event_id") % len(DIAGNOSES) == F.col("k"))  # four rows

    def filled(c: str) -> F.Column:
        return F.replace(F.replace(F.col(c), F.lit("{n}"), F.col("user_id").cast("string")), F.lit("{x}"), F.md5(F.col("event_id").cast("string")))

    return lab.diagnosed(events.select("event_id", filled("line").alias("sample"), filled("value").alias("value")), id_col="event_id").select("event_id", "verdict")


_PROPOSED = [("extend_builtin", "host-kv", "null"), ("new_pattern", None, rendered.quoted(r"(?i)\bassetTag[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9._@\\\-]+)")), ("literal", None, r"'(?<!\w)QQ' || event_id % 500 + 10 || '(?!\w)'")]
_PROPOSED_SQL = " union all ".join(f"select event_id, {k} as place, '{kind}' as kind, {f"'{rule}'" if rule else 'null'} as rule_id, 'HOST' as label, {regex} as new_regex, 0 as also_masked from events" for k, (kind, rule, regex) in enumerate(_PROPOSED, 1))


@query("propose_rules", _PROPOSED_SQL)
def propose_rules(spark, sf_dir):
    """Proposals for a value that no rule masks, over all events, each tried on its sample."""
    tag = F.concat(F.lit("QQ"), (F.col("event_id") % 500 + 10).cast("string"))
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("2024 assetTag="), tag, F.lit(" seen")).alias("sample"), tag.alias("value"))
    found = lab.suggested(rows, id_col="event_id")
    return found.select("event_id", "place", "kind", "rule_id", "label", F.when(F.col("kind") != "extend_builtin", F.col("regex")).alias("new_regex"), F.size("also_masked").alias("also_masked"))


_CODECS = [("utf-8", "EFBBBF", "\r\n"), ("utf-16-le", "", "\n"), ("utf-16-be", "", "\r"), ("utf-16-le", "FFFE", "\r\n"), ("utf-8", "", "\r")]


@query("decode_files", "select s_suppkey as k, 'a' || chr(10) || 'b' || s_name || ' ends here' as text, (['utf-8', 'utf-16-le', 'utf-16-be', 'utf-16-le', 'utf-8'])[s_suppkey % 5 + 1] as encoding from supplier")
def decode_files(spark, sf_dir):
    """A file for each supplier: bytes in five encodings, with and without marks and with each kind of line end."""
    key, content = F.col("s_suppkey"), None
    for k, (codec, mark, end) in enumerate(_CODECS):
        raw = F.concat(F.unhex(F.lit(mark)), F.encode(F.concat(F.lit("a" + end + "b"), "s_name", F.lit(" ends here")), codec.replace("16-le", "16LE").replace("16-be", "16BE")))
        content = F.when(key % 5 == k, raw) if content is None else content.when(key % 5 == k, raw)
    files = _table(spark, sf_dir, "supplier").select(key.cast("string").alias("path"), content.alias("content"))
    return text_source.decoded(files).select(F.col("path").cast("long").alias("k"), "text", "encoding")


@query(
    "workbooks",
    r"""select s_suppkey as k, '# --- Sheet: People ---' || chr(10) || 'name,' || s_name || chr(13) || chr(10) || s_suppkey || ',true' || chr(13) || chr(10) || chr(10) || '# --- Sheet: Notes ---' || chr(10) || '"a, ' || s_name || '"' || chr(13) || chr(10) as csv from supplier""",
)
def workbooks(spark, sf_dir):
    """A spreadsheet of two sheets for each supplier, read sheet by sheet."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_name")
    files = rows.mapInArrow(rendered.workbooks, "path string, content binary")
    return xlsx.put_together(xlsx.sheets(files)).select(F.col("path").cast("long").alias("k"), "csv")


@query("split_terms", "select event_id, unnest(['ACME' || user_id, 'srv', 'x y']) as term from events")
def split_terms(spark, sf_dir):
    """Terms as typed for each event: parted by commas and line ends, trimmed, each once whatever its case."""
    user = F.col("user_id").cast("string")
    typed = F.concat(F.lit(" ACME"), user, F.lit(", acme"), user, F.lit("\nsrv,,x y ,SRV"))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(registry.terms_of(typed)).alias("term"))


@query("entity_join", f"with {_NUMBER_SQL} select doc_id, lang, source, count(*) as n_values from numbered join documents using (doc_id) group by all")
def entity_join(spark, sf_dir):
    """Numbered mailboxes by document, with its language and source."""
    numbered = masking.number(_mail_places(spark, sf_dir))
    return numbered.join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").groupBy("doc_id", "lang", "source").agg(F.count(F.lit(1)).alias("n_values"))


MODELS = [("openai", "gpt-9-mini", 1), ("openai", "gpt-9-audio", 0), ("openai", "o7", 1), ("openai", "text-embedding", 0), ("google", "models/gemini-9-flash", 1), ("google", "models/gemini-9-tts", 0), ("google", "models/bison", 0), ("azure", "x", 0), ("ollama", "llama", 1)]


@query("chat_models", f"select distinct user_id, provider, regexp_replace(model, '^models/', '') as model from {_cases_sql('events', 'event_id', MODELS, 'provider, model, keep')} where keep = 1")
def chat_models(spark, sf_dir):
    """The models that chat, of those that each user's events name."""
    rows = _cases(spark, sf_dir, "events", "event_id", [m[:2] for m in MODELS], "provider string, model string").join(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    kept = providers.chat_models(rows)
    named = rows.withColumn("model", F.regexp_replace("model", "^models/", "")).join(F.broadcast(kept), ["provider", "model"])  # as many as models
    return named.select("user_id", "provider", "model").distinct()


ENDPOINTS = [
    ("", "missing"), ("ftp://a", "scheme"), ("a.example", "scheme"), ("http://", "host"), ("https://metadata.google.internal/x", "metadata"), ("http://169.254.169.254/latest", "network"), ("http://[fe80::1]:80/", "network"),
    ("http://100.64.1.1", "network"), ("http://100.63.1.1", None), ("http://127.0.0.1:11434", None), ("https://u:p@res.example.com:443/x?y", None), ("http://[::1]:11434", None),
]


@query("endpoint_refusals", f"select event_id as id, url, refusal from {_cases_sql('events', 'event_id', ENDPOINTS, 'url, refusal')} union all select -1 - page_id, url, null from pages")
def endpoint_refusals(spark, sf_dir):
    """Endpoints of all events, and the pages' own addresses, which may all be used."""
    cases = _cases(spark, sf_dir, "events", "event_id", [(u,) for u, _ in ENDPOINTS], "url string").select(F.col("event_id").alias("id"), "url")
    rows = cases.unionByName(_table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), "url"))
    return rows.select("id", "url", providers.refusal(F.col("url")).alias("refusal"))


@query("provider_registry", f"with {_AUDIT_SQL}, asked as (select provider as p, count(*) as n from audit group by 1) select provider, auth, needs_key, coalesce(n, 0) as requests from (values " + ", ".join(f"('{p}', '{a}', {str(a == 'apikey').lower()})" for p, _, a, _ in providers.PROVIDERS) + ") t(provider, auth, needs_key) left join asked on p = provider")
def provider_registry(spark, sf_dir):
    """The providers, and how many requests of the log each has."""
    asked = _audit(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("requests"))
    return providers.registry(spark).join(asked, "provider", "left").select("provider", "auth", "needs_key", F.coalesce("requests", F.lit(0)).alias("requests"))


@query("clean_answers", "select event_id, 'user' || user_id || ' did it' as answer from events")
def clean_answers(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", providers.cleaned(F.concat(F.lit(" <Person>user"), "user_id", F.lit("</Person> did it[^3^] "))).alias("answer"))


@query("usage_blocks", "select event_id, event_id + 10 as input_tokens, user_id as output_tokens from events")
def usage_blocks(spark, sf_dir):
    """Token counts from providers' own shapes."""
    e = _table(spark, sf_dir, "events")
    block = {p: F.to_json(F.struct((F.col("event_id") + 10).alias(a), F.col("user_id").alias(b))) for p, (a, b) in {"openai": ("prompt_tokens", "completion_tokens"), "google": ("promptTokenCount", "candidatesTokenCount")}.items()}
    usage = F.when(F.col("event_id") % 2 == 0, ledger.usage_of(block["openai"], "openai")).otherwise(ledger.usage_of(block["google"], "google"))
    return e.select("event_id", usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked, with what residue scanning finds in the result."""
    masked = masking.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = leaks.findings(F.col("masked"))
    return masked.select("doc_id", "masked", F.size("spans").alias("n_spans"), found.alias("f")).select(
        "doc_id", "masked", "n_spans", F.size("f").alias("n_findings"), F.exists("f", lambda x: x["severity"] == "high").alias("blocks")
    )


query("mask_and_scan")(flagship)
