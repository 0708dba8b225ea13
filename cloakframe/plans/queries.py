"""The catalogue of queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities, hosts, numbers
from ..functions.patterns import ALLOW_LISTS, DETECTORS, PATTERNS, by_name, java_pattern, re2_pattern
from ..operators import detect, json_body, resolve
from ..operators.rules import Compiled, Rules
from ..operators.vault import Vault, new_values, numbered
from ..sources.shared import shared_path
from ..streaming.sse import flush_boundary, restore_stream
from .plants import FORMS, PLANTS, RESTORED, by_row, expression, form_sql, form_text, planted_sql, planted_text
from .redactor import Redactor

SALT = "cloakframe"  # fixed, so that SQL can tell the placeholders
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(pattern: str) -> str:
    return re2_pattern(pattern).replace("'", "''")


def only(*names: str) -> Compiled:
    return Compiled(disabled=frozenset(d.name for d in DETECTORS) - set(names))


# -- detectors ------------------------------------------------------------------------------------------------------


def planted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = table(spark, sf_dir, "customer").select("c_custkey", F.expr(planted_text(name)).alias("text"))
        found = text.withColumn("d", F.explode(detect.scan(F.col("text"), only(name))["dets"]))
        return found.select("c_custkey", F.expr("substring(text, d.start + 1, d.end - d.start)").alias("value"))

    return run


for _name in PLANTS:
    query(f"detect_{_name.replace('.', '_')}", planted_sql(_name))(planted(_name))



@query("detect_forms", form_sql())
def detect_forms(spark, sf_dir):
    """Every further form of detectors that have several, with all detectors at work, and what must not be taken for one."""
    wanted = F.expr(by_row([f"'{d}'" for d, *_ in FORMS]))
    text = table(spark, sf_dir, "customer").select("c_custkey", F.expr(form_text()).alias("text"), wanted.alias("detector"))
    names = F.array(*[F.lit(d.name) for d in DETECTORS])
    found = text.withColumn("d", F.explode(detect.scan(F.col("text"), Compiled())["dets"])).where(F.get(names, F.col("d.det_ord")) == F.col("detector"))
    return found.select("c_custkey", "detector", F.expr("substring(text, d.start + 1, d.end - d.start)").alias("value"))


REAL_IP = r"NOT (a = 127 OR a = 240 OR (a = 198 AND b IN (18, 19)) OR (a, b, c) IN ((192, 0, 2), (198, 51, 100), (203, 0, 113)))"
IPS_SQL = f"""
WITH m AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{quoted(PATTERNS["ipv4"])}')) AS v,
         generate_subscripts(regexp_extract_all(text, '{quoted(PATTERNS["ipv4"])}'), 1) - 1 AS k FROM documents),
p AS (
  SELECT *, string_split(v, '.') AS x, CAST(string_split(v, '.')[1] AS INT) AS a, CAST(string_split(v, '.')[2] AS INT) AS b,
         CAST(string_split(v, '.')[3] AS INT) AS c FROM m),
ips AS (SELECT doc_id, k, v, a || '.' || b || '.' || c AS network, x[4] AS host FROM p WHERE {REAL_IP} AND NOT regexp_matches(v, '(^|[.])0[0-9]')),
f AS (SELECT network, min((doc_id, k)) AS first FROM ips GROUP BY network),
n AS (SELECT network, row_number() OVER (ORDER BY first) - 1 AS slot FROM f),
t AS (
  SELECT network, slot, CASE WHEN slot < 512 THEN '198.' || (18 + slot // 256) || '.' || (slot % 256)
                        ELSE '240.' || ((slot - 512) // 256) || '.' || ((slot - 512) % 256) END AS token FROM n)
"""


def ipv4_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, k, v, network, host): the addresses that are replaced, k-th match of a document; all in the JVM."""
    found = F.when(F.contains("text", F.lit(".")), F.regexp_extract_all("text", F.lit(java_pattern(PATTERNS["ipv4"])), F.lit(0)))
    rows = docs.select("doc_id", F.posexplode(found).alias("k", "v")).withColumn("x", F.split("v", "\\."))
    a, b, c = (F.element_at("x", k).cast("int") for k in (1, 2, 3))
    sample = (a == 192) & (b == 0) & (c == 2) | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
    made = (a == 240) | (a == 198) & b.isin(18, 19)
    kept = rows.where(~((a == 127) | sample | made) & ~F.col("v").rlike("(?:\\A|[.])0[0-9]"))
    return kept.select("doc_id", "k", "v", F.concat_ws(".", *(F.element_at("x", k) for k in (1, 2, 3))).alias("network"), F.element_at("x", 4).alias("host"))


def ipv4_slots(found: DataFrame) -> DataFrame:
    """(network, slot, token) in the order of first sight. Networks are as many as there are placeholders at most."""
    first = found.groupBy("network").agg(F.min(F.struct("doc_id", "k")).alias("first"))
    n = F.row_number().over(Window.orderBy("first")) - 1
    slot = F.col("slot")
    low = F.concat(F.lit("198."), (18 + F.floor(slot / 256)).cast("string"), F.lit("."), (slot % 256).cast("string"))
    high = F.concat(F.lit("240."), F.floor((slot - 512) / 256).cast("string"), F.lit("."), ((slot - 512) % 256).cast("string"))
    return first.withColumn("slot", n.cast("long")).select("network", "slot", F.when(slot < 512, low).otherwise(high).alias("token"))


@query("ipv4_network_tokens", IPS_SQL + "SELECT network, slot, token FROM t")
def ipv4_network_tokens(spark, sf_dir):
    return ipv4_slots(ipv4_matches(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    "ipv4_tokenize_documents",
    IPS_SQL
    + f""", r AS (SELECT i.doc_id, i.k, t.token || '.' || i.host AS new FROM ips i JOIN t USING (network)),
s AS (
  SELECT m.doc_id, list(coalesce(r.new, m.v) ORDER BY m.k) AS new FROM m LEFT JOIN r ON m.doc_id = r.doc_id AND m.k = r.k GROUP BY m.doc_id)
SELECT d.doc_id, CASE WHEN s.new IS NULL THEN d.text ELSE
         array_to_string(list_transform(list_zip(string_split_regex(d.text, '{quoted(PATTERNS["ipv4"])}'), s.new), lambda x: x[1] || coalesce(x[2], '')), '') END AS text
FROM documents d LEFT JOIN s USING (doc_id)
""",
)
def ipv4_tokenize_documents(spark, sf_dir):
    """Documents with their IPv4 networks replaced: only rows with a match are joined, so texts without one don't move twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matches, path = ipv4_matches(docs), shared_path(spark, "ipv4-found")
    matches.write.parquet(path)  # texts are searched once
    found = spark.read.schema(matches.schema).parquet(path)
    new = found.join(ipv4_slots(found), "network").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.concat_ws(".", "token", "host")))).alias("new"))
    java = java_pattern(PATTERNS["ipv4"])
    old = F.regexp_extract_all("text", F.lit(java), F.lit(0))
    pieces = F.zip_with(F.split("text", java, -1), F.transform(old, lambda v, k: F.coalesce(F.element_at("new", k), v)), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
    return docs.join(new, "doc_id", "left").select("doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


PHONE = quoted(by_name("contact.phone").pattern)


@query(
    "phones_in_documents",
    f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS value FROM documents)
SELECT doc_id, value, count(*) AS n FROM m WHERE NOT contains(replace(replace(value, '.', '-'), ' ', '-'), '555-01') GROUP BY doc_id, value""",
)
def phones_in_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("d", F.explode(detect.scan(F.col("text"), only("contact.phone"))["dets"]))
    return found.select("doc_id", F.expr("substring(text, d.start + 1, d.end - d.start)").alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reserved_hosts_untouched",
    "SELECT count(*) AS texts, count(*) FILTER (own) AS found FROM (SELECT false AS own FROM pages UNION ALL SELECT doc_id % 7 = 0 FROM documents)",
)
def reserved_hosts_untouched(spark, sf_dir):
    """Hosts of all pages' URLs and all documents, to some of which one is added: all others are reserved names, so no detection."""
    own = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" see db.acme"), F.col("doc_id").cast("string"), F.lit(".co.uk"))).otherwise(F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("text", F.lit("")), own).alias("text"))
    texts = table(spark, sf_dir, "pages").select(F.col("url").alias("text")).unionByName(docs)
    found = texts.select(F.size(detect.scan(F.col("text"), only("contact.email", "network.domain"))["dets"]).alias("n"))
    return found.agg(F.count(F.lit(1)).alias("texts"), F.sum("n").cast("long").alias("found"))


# -- vetoes, overlaps -------------------------------------------------------------------------------------------------

SPANS = "l_orderkey AS case_id, CAST((l_linenumber * 7 + l_partkey) % 23 AS INT) AS start, CAST((l_linenumber * 7 + l_partkey) % 23 + 1 + l_suppkey % 9 AS INT) AS \"end\", CAST(l_partkey % 43 AS INT) AS det_ord, CAST(l_linenumber AS INT) AS seq"


def spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*SPANS.replace('"', "`").split(", "))


@query(
    "resolve_overlaps",
    f"""WITH RECURSIVE s AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start, "end" - start DESC, det_ord, seq) AS rn FROM (SELECT {SPANS} FROM lineitem)),
r AS (
  SELECT case_id, rn, start, "end", det_ord, true AS kept, "end" AS upto FROM s WHERE rn = 1
  UNION ALL
  SELECT s.case_id, s.rn, s.start, s."end", s.det_ord, s.start >= r.upto, CASE WHEN s.start >= r.upto THEN s."end" ELSE r.upto END
  FROM r JOIN s ON s.case_id = r.case_id AND s.rn = r.rn + 1)
SELECT case_id, start, "end", det_ord FROM r WHERE kept""",
)
def resolve_overlaps(spark, sf_dir):
    grouped = spans(spark, sf_dir).groupBy("case_id").agg(F.collect_list(F.struct("start", "end", "det_ord", "seq")).alias("dets"))
    return grouped.select("case_id", F.explode(resolve.resolve_overlaps(F.col("dets"))).alias("d")).select("case_id", "d.start", "d.end", "d.det_ord")


@query(
    "already_tokenized_antijoin",
    f"""WITH d AS (SELECT DISTINCT {SPANS} FROM lineitem),
m AS (SELECT o_orderkey AS case_id, o_custkey % 20 AS start, o_custkey % 20 + 3 AS "end" FROM orders WHERE o_custkey % 2 = 0)
SELECT case_id, start, "end", seq FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = d.case_id AND d.start < m."end" AND m.start < d."end")""",
)
def already_tokenized_antijoin(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").selectExpr("o_orderkey AS case_id", "o_custkey % 20 AS start", "o_custkey % 20 + 3 AS `end`")
    return resolve.overlap_antijoin(spans(spark, sf_dir).distinct(), marks, ["case_id"], 16).select("case_id", "start", "end", "seq")


HOSTS = "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'api.github.com' WHEN 1 THEN 'my' || 'github.com' WHEN 2 THEN 'GITLAB.com' WHEN 3 THEN 'github.com.acme' || c_custkey || '.net' ELSE 'acme' || c_custkey || '.com' END"


@query(
    "allow_veto",
    f"""SELECT c_custkey, host FROM (SELECT c_custkey, {HOSTS} AS host FROM customer)
WHERE NOT regexp_matches(host, '(?i)^(.*[.])?(github[.]com|gitlab[.]com)$') AND NOT regexp_matches(host, '^acme1')""",
)
def allow_veto(spark, sf_dir):
    """Rows whose host stays a detection: not on the platforms' allow list, nor matched by an operator's allow pattern."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(HOSTS).alias("host"))
    one = F.array(F.struct(F.array(F.struct(F.col("host").alias("real"))).alias("lookups")))
    allow = resolve.allow_pattern(["acme1[0-9]*[.]com"], ALLOW_LISTS["wellknown_platforms"])
    return rows.where(F.size(resolve.allow_veto(one, allow)) > 0)


NOTE = "'call ' || CASE WHEN c_custkey % 3 = 0 THEN 'AcMe' ELSE 'other' END || c_custkey || ' today'"


@query("block_substring", "SELECT c_custkey, 'AcMe' AS value FROM customer WHERE c_custkey % 3 = 0")
def block_substring(spark, sf_dir):
    rules = Rules(block=[{"value": "acme"}]).compiled()
    found = table(spark, sf_dir, "customer").select("c_custkey", F.expr(NOTE).alias("text")).withColumn("d", F.explode(detect.scan(F.col("text"), rules, True)["dets"]))
    return found.select("c_custkey", F.expr("substring(text, d.start + 1, d.end - d.start)").alias("value"))


@query("allow_beats_block", f"SELECT c_custkey, {NOTE} AS text FROM customer")
def allow_beats_block(spark, sf_dir):
    """A value that is allowed and blocked stays."""
    rules = Rules(block=[{"value": "acme"}], allow=[{"value": "AcMe"}])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(NOTE).alias("text"))
    return Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT), rules).tokenize(rows, "c_custkey", "text").rows


# -- vault ------------------------------------------------------------------------------------------------------------


def token_sql(entity: str, value: str, n: int, generation: str = "0") -> str:
    prefix = entities.SHAPES[entity][0]
    return f"'{prefix}' || substr(sha256('{SALT}|' || {generation} || '|{entity}|' || {value} || '|0'), 1, {n})"


@query("vault_get_or_create", f"SELECT c_name AS real, {token_sql('github_token', 'c_name', 32)} AS token, c_custkey % 5 = 0 AS known FROM customer")
def vault_get_or_create(spark, sf_dir):
    """Known values keep their placeholders, new ones get theirs; both through the stored vault, in two batches."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("real"), F.lit("github_token").alias("entity_type"), F.col("c_custkey").alias("place"))
    vault = Vault(spark, shared_path(spark, "vault"), salt=SALT)
    vault.get_or_create(names.where("place % 5 = 0"))
    known = vault.entries().select("real", F.lit(True).alias("k"))  # reads the batches of now, not of later
    return vault.get_or_create(names).join(known, "real", "left").select("real", "token", F.coalesce("k", F.lit(False)).alias("known"))


@query("vault_new_values", "SELECT DISTINCT c_name AS real FROM customer WHERE c_custkey % 5 <> 0")
def vault_new_values(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("real"), "c_custkey")
    return new_values(names, names.where("c_custkey % 5 = 0").select("real"))


ENTITY = "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'github_token' WHEN 1 THEN 'npm_token' ELSE 'pem_key' END"


@query("vault_report", f"SELECT entity_type, count(*) AS n FROM (SELECT {ENTITY} AS entity_type FROM customer) GROUP BY ROLLUP (entity_type)")
def vault_report(spark, sf_dir):
    vault = Vault(spark, shared_path(spark, "vault"), salt=SALT)
    vault.get_or_create(table(spark, sf_dir, "customer").select(F.col("c_name").alias("real"), F.expr(ENTITY).alias("entity_type"), F.col("c_custkey").alias("place")))
    return vault.report()


def named(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("real"), F.lit("github_token").alias("entity_type"), F.col("c_custkey").alias("place"))


@query(
    "vault_delete",
    f"""SELECT c_name AS real, {token_sql("github_token", "c_name", 32, "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END")} AS token,
CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS generation FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 6 = 0""",
)
def vault_delete(spark, sf_dir):
    """Removed values have no placeholder until they are seen again, then a new one."""
    vault, names = Vault(spark, shared_path(spark, "vault"), salt=SALT), named(spark, sf_dir)
    vault.get_or_create(names)
    vault.remove(names.where("place % 3 = 0").select("real"))
    vault.get_or_create(names.where("place % 6 = 0"))
    return vault.entries().select("real", "token", "generation")


@query("vault_list", "SELECT c_name AS real, rank() OVER (ORDER BY c_custkey) AS place FROM customer")
def vault_list(spark, sf_dir):
    """Entries in the order in which their batches and values came, each with its place."""
    vault = Vault(spark, shared_path(spark, "vault"), salt=SALT)
    vault.get_or_create(named(spark, sf_dir).withColumn("entity_type", F.lit("ipv6_network")))
    listed = numbered(vault.entries().select("real", "first_seen", "seq"), ["first_seen", "seq"], shared_path(spark, "listed"))
    return listed.select("real", (F.col("n") + 1).alias("place"))


@query(
    "vault_lookup",
    f"""SELECT c_name AS real, CASE WHEN c_custkey % 4 <> 0 THEN {token_sql("password", "c_name", 24)} END AS token, c_custkey % 4 <> 0 AS label_only FROM customer""",
)
def vault_lookup(spark, sf_dir):
    """Lookups never mint; values that only a label gives away are listed apart."""
    vault, names = Vault(spark, shared_path(spark, "vault"), salt=SALT), named(spark, sf_dir).withColumn("entity_type", F.lit("password"))
    vault.get_or_create(names.where("place % 4 <> 0"))
    own = vault.label_only().select("real", F.lit(True).alias("l"))
    return vault.lookup(names.select("real")).join(own, "real", "left").select("real", "token", F.coalesce("l", F.lit(False)).alias("label_only"))


# -- scalar functions -------------------------------------------------------------------------------------------------

NUMBER = "lpad(CAST(o_orderkey * 7919 % 1000000007 AS {S}), 12, '2')"
DUCK_TIMES = str(numbers.TIMES)
DUCK_POWERS = str(numbers.POWERS)


@query(
    "verhoeff_valid",
    f"""WITH n AS (SELECT o_orderkey, {NUMBER.replace("{S}", "VARCHAR")} AS digits FROM orders),
p AS (SELECT *, list_transform(range(0, 12), lambda i: {DUCK_POWERS}[i % 8 + 1][CAST(substr(digits, 12 - CAST(i AS INT), 1) AS INT) + 1]) AS places FROM n)
SELECT o_orderkey, digits, list_reduce(list_prepend(0, places), lambda c, x: {DUCK_TIMES}[c + 1][x + 1]) = 0 AS valid FROM p""",
)
def verhoeff_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NUMBER.replace("{S}", "STRING")).alias("digits"))
    return rows.withColumn("valid", numbers.verhoeff_column(F.col("digits")))


RUN = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '4567' WHEN 1 THEN '8765' WHEN 2 THEN '33333' ELSE CAST(c_custkey AS {S}) || '05' END"


@query(
    "degenerate_run",
    f"""WITH n AS (SELECT c_custkey, {RUN.replace("{S}", "VARCHAR")} AS digits FROM customer),
s AS (SELECT *, list_distinct(list_transform(range(1, length(digits)), lambda i: CAST(substr(digits, CAST(i AS INT) + 1, 1) AS INT) - CAST(substr(digits, CAST(i AS INT), 1) AS INT))) AS steps FROM n)
SELECT c_custkey, digits, length(digits) > 0 AND (len(steps) = 0 OR (len(steps) = 1 AND steps[1] BETWEEN -1 AND 1)) AS degenerate FROM s""",
)
def degenerate_run(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(RUN.replace("{S}", "STRING")).alias("digits"))
    return rows.withColumn("degenerate", numbers.run_of_digits_column(F.col("digits")))


def codes(n: int) -> str:
    return ", ".join(f"'{c}'" for c in sorted(numbers.CALLING_CODES) if len(c) == n)


@query(
    "calling_code_split",
    f"""SELECT o_orderkey, digits, CASE WHEN substr(digits, 1, 3) IN ({codes(3)}) THEN substr(digits, 1, 3) WHEN substr(digits, 1, 2) IN ({codes(2)}) THEN substr(digits, 1, 2)
WHEN substr(digits, 1, 1) IN ({codes(1)}) THEN substr(digits, 1, 1) END AS code
FROM (SELECT o_orderkey, CAST(o_orderkey * 104729 % 899999999 + 100000000 AS VARCHAR) AS digits FROM orders)""",
)
def calling_code_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(o_orderkey * 104729 % 899999999 + 100000000 AS STRING)").alias("digits"))
    return rows.withColumn("code", numbers.calling_code_column(F.col("digits")))


@query("pan_holder", "SELECT c_custkey, pan, substr(pan, 4, 1) IN ('P','C','H','A','B','G','J','L','F','T') AS valid FROM (SELECT c_custkey, 'ABC' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'K1234Z' AS pan FROM customer)")
def pan_holder(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("'ABC' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'K1234Z'").alias("pan"))
    return rows.withColumn("valid", F.substring("pan", 4, 1).isin(*"PCHABGJLFT"))


SPLITS = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'mail.acme' || c_custkey || '.co.uk' WHEN 1 THEN 'a.t' || c_custkey || '.okta.com' WHEN 2 THEN 'acme-vpn.acme-co' || c_custkey || '.com' ELSE 'x' || c_custkey || '.nosuchtop' END"


@query(
    "host_split",
    """SELECT c_custkey, before, label, suffix, leaks FROM (SELECT c_custkey,
CASE c_custkey % 4 WHEN 0 THEN 'mail.' WHEN 1 THEN 'a.' WHEN 2 THEN 'acme-vpn.' END AS before,
CASE c_custkey % 4 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 't' || c_custkey WHEN 2 THEN 'acme-co' || c_custkey END AS label,
CASE c_custkey % 4 WHEN 0 THEN 'co.uk' WHEN 1 THEN 'okta.com' WHEN 2 THEN 'com' END AS suffix,
CASE c_custkey % 4 WHEN 2 THEN true WHEN 3 THEN NULL ELSE false END AS leaks FROM customer)""",
)
def host_split(spark, sf_dir):
    """Public and tenant suffixes, and whether subdomains leak the organisation's name; unknown top levels are no hosts."""

    @F.pandas_udf("struct<before:string,label:string,suffix:string,leaks:boolean>")
    def each(names):
        import pandas as pd

        rows = [(*p, hosts.leaks(p[0], p[1])) if (p := hosts.split_host(n)) else (None, None, None, None) for n in names]
        return pd.DataFrame(rows, columns=["before", "label", "suffix", "leaks"])

    return table(spark, sf_dir, "customer").select("c_custkey", each(F.expr(SPLITS)).alias("p")).select("c_custkey", "p.*")


LAST = r"""regexp_extract(text, '[^ \t\n\r`"'',;()\[\]{}|]*\z')"""
HELD = f"list_min(list_filter(range(32, 129), lambda k: strlen(right({LAST}, CAST(k AS INT))) >= 128))"


def boundary_sql(keys: str, source: str) -> str:
    """The text is cut before its last word, or where 128 bytes of a longer word begin."""
    return f"SELECT {keys}, length(text) - CASE WHEN strlen({LAST}) > 128 THEN {HELD} ELSE length({LAST}) END AS cut FROM ({source})"


def cut(text) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: flush_boundary(t or "")), "long")(text)


@query("stream_flush_boundary", boundary_sql("conv_id, turn", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations"))
def stream_flush_boundary(spark, sf_dir):
    """Where a buffer can be cut."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut("text").alias("cut"))


@query("stream_flush_long_words", boundary_sql("doc_id", "SELECT doc_id, translate(coalesce(text, ''), ' .,;', '____') AS text FROM documents"))
def stream_flush_long_words(spark, sf_dir):
    """The same of words that are longer than what may be held."""
    return table(spark, sf_dir, "documents").select("doc_id", cut(F.translate("text", " .,;", "____")).alias("cut"))


@query("stream_restore", f"SELECT CAST(c_custkey AS VARCHAR) AS stream_id, {planted_text('vcs.github', True)} AS text, 3 AS others FROM customer")
def stream_restore(spark, sf_dir):
    """Tokenized texts sent as frames, a few characters each and dealt over files at random, put together after the stream."""
    redactor, done = tokenized(spark, sf_dir, "vcs.github")
    size = 7
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size)), lambda k: F.substring(F.col("text"), k * size + 1, F.lit(size)))
    delta = lambda x: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), x.alias("text")).alias("delta")))
    plain = lambda x: F.array(F.lit(json.dumps(x)))
    events = F.concat(plain({"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}), F.transform(parts, delta), plain({"type": "content_block_stop", "index": 0}), plain({"type": "message_stop"}))
    frames = done.rows.select(F.col("c_custkey").cast("string").alias("stream_id"), F.posexplode(events).alias("seq", "data"))
    folder, sink = shared_path(spark, "frames"), shared_path(spark, "restored")
    frames.select("stream_id", F.col("seq").cast("long").alias("seq"), F.get_json_object("data", "$.type").alias("event"), "data").repartition(4, F.xxhash64("data", "seq", "stream_id")).write.json(folder)
    stream = spark.readStream.schema("stream_id string, seq long, event string, data string").option("maxFilesPerTrigger", 2).json(folder)
    restore_stream(redactor, stream, sink, shared_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("stream_id string, seq long, part int, event string, data string").option("recursiveFileLookup", True).parquet(sink)
    text = F.get_json_object("data", "$.delta.text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("seq", "part", text.alias("text"))))), lambda x: x["text"]), "")
    return got.groupBy("stream_id").agg(joined.alias("text"), F.count(F.when(F.col("event") != "content_block_delta", 1)).cast("int").alias("others"))


@query("dedupe_scan", "SELECT sha256(text) AS h, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def dedupe_scan(spark, sf_dir):
    """What a scan reads: each text once, whatever its copies; null texts are counted together."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))


@query(
    "category_catalogue",
    f"SELECT category, NOT (category LIKE 'network.%' OR category = 'contact.phone') AS enabled FROM (VALUES {', '.join(f"('{n}')" for n in PLANTS)}) AS t(category)",
)
def category_catalogue(spark, sf_dir):
    """Every detector is a category; a group and a category of another are switched off for one run."""
    rules = Rules()
    rules.reconcile()
    held = [(n, bool(c["enabled"])) for n, c in rules.without("network", "contact.phone").categories.items() if not n.startswith("allowlist.")]
    return spark.createDataFrame(held, "category string, enabled boolean")


# -- JSON bodies ------------------------------------------------------------------------------------------------------

GITHUB = f"'gh' || 'p_' || {'substr({H}, 1, 40)'}"
BODY = """'{"model": "m", "system": "s ' || c_custkey || '", "messages": [{"role": "user", "content": "' || {V} || ' x"}, {"role": "user", "content": [{"type": "tool_use", "input": {"k' || c_custkey || '": 1.50}}]}]}'"""


def body(duck: bool, value: str = GITHUB) -> str:
    return expression(BODY.replace("{V}", value), duck)


@query("json_paths", f"SELECT c_custkey, 0 AS k, {expression(GITHUB, True)} || ' x' AS text FROM customer UNION ALL SELECT c_custkey, 1, 'k' || c_custkey FROM customer")
def json_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(body(False)).alias("body"))
    return rows.select("c_custkey", F.posexplode(json_body.flatten(F.col("body"))["fields"]).alias("k", "f")).select("c_custkey", "k", F.col("f.segs")[0]["text"].alias("text"))


#: Bodies ({K}: the row's key) and the texts of them that are scanned, in order of place.
ROUTES = (
    ('{"messages":[{"content":[{"type":"thinking","thinking":"t{K}"},{"type":"text","text":"a{K}"}]}]}', ("a{K}",)),
    ('{"messages":[{"content":[{"type":"tool_result","content":"r{K}"}]}]}', ("r{K}",)),
    ('{"messages":[{"content":[{"type":"tool_result","content":[{"type":"text","text":"x{K}"},{"type":"search_result","source":"s{K}","title":"t","content":[{"type":"text","text":"c{K}"}],"citations":{"enabled":true}}]}]}]}', ("x{K}", "s{K}", "t", "c{K}")),
    ('{"requests":[{"custom_id":"q","params":{"messages":[{"content":"b{K}"}]}}]}', ("b{K}",)),
    ('{"result":{"type":"succeeded","message":{"content":[{"type":"text","text":"m{K}"}]}}}', ("m{K}",)),
    ('{"tools":[{"name":"mcp__a","description":"d{K}","input_schema":{"title":"h","properties":{"p":{"description":"e{K}","enum":["v{K}"]}}}},{"name":"own","description":"no"}]}', ("d{K}", "h", "e{K}", "v{K}")),
    ('{"safeguards":{"type":"x","note":["g{K}"],"tool_use_ids":["id"]}}', ("g{K}",)),
    ('{"messages":[{"content":[{"type":"tool_use","id":"i","name":"n","input":{"k{K}":{"y":["z{K}",1,null]}}}]}]}', ("k{K}", "y", "z{K}")),
    ('{"messages":[{"content":[{"type":"image","source":{"data":"no"}},{"type":"fallback","from":{"model":"a"},"to":{"model":"b"}},{"type":"compaction","content":null}]}]}', ()),
    ('{"messages":[{"content":"p{K}<system-reminder>## Auto Mode Active q</system-reminder>r{K}"}]}', ("p{K}", "r{K}")),
)


def keyed_text(text: str) -> str:
    return "replace('{}', '{{K}}', CAST(c_custkey AS {{S}}))".format(text.replace("'", "''"))


@query("json_routes", " UNION ALL ".join(f"SELECT c_custkey, {k} AS k, {keyed_text(t).replace('{S}', 'VARCHAR')} AS text FROM customer WHERE c_custkey % {len(ROUTES)} = {r}" for r, (_, texts) in enumerate(ROUTES) for k, t in enumerate(texts)))
def json_routes(spark, sf_dir):
    """Which strings of every kind of block, tool, batch and result are scanned; reminders of fixed kinds are not."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(by_row([keyed_text(b).replace("{S}", "STRING") for b, _ in ROUTES])).alias("body"))
    texts = F.flatten(F.transform(json_body.flatten(F.col("body"))["fields"], lambda f: F.transform(F.filter(f["segs"], lambda x: x["scan"]), lambda x: x["text"])))
    return rows.select("c_custkey", F.posexplode(texts).alias("k", "text"))


KINDS = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '{"messages":[]}' WHEN 1 THEN '{"a":1,"a":2}' WHEN 2 THEN '{"messages":[{"content":[{"type":"odd"}]}]}' WHEN 3 THEN '{"a":1} x' ELSE '{"a":' END"""


@query(
    "json_safe_bodies",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a key is repeated' WHEN 2 THEN 'unknown block type ''odd''' WHEN 3 THEN 'text after the value' ELSE 'not JSON' END AS error FROM customer",
)
def json_safe_bodies(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(KINDS).alias("body"))
    return rows.select("c_custkey", json_body.flatten(F.col("body"))["error"].alias("error"))


@query("json_tokenize_bodies", f"SELECT c_custkey, {body(True, token_sql('github_token', GITHUB, 32))} AS body FROM customer")
def json_tokenize_bodies(spark, sf_dir):
    """Bodies with the tokens in their messages replaced and every other byte as it was."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(body(False)).alias("body"))
    return json_body.tokenize_bodies(Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT)), rows, "c_custkey", "body")[0]


@query("json_roundtrip_bodies", f"SELECT c_custkey, {body(True)} AS body FROM customer")
def json_roundtrip_bodies(spark, sf_dir):
    redactor = Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(body(False)).alias("body"))
    return json_body.detokenize_bodies(redactor, json_body.tokenize_bodies(redactor, rows, "c_custkey", "body")[0], "c_custkey", "body")


# -- there and back ---------------------------------------------------------------------------------------------------


def tokenized(spark, sf_dir, name: str, choose: str = "CASE WHEN c_custkey % 3 = 0 THEN {stays} ELSE {value} END", rules: Compiled | None = None):
    before, value, stays, after = PLANTS[name]
    text = expression(f"{before} || {choose.replace('{stays}', stays).replace('{value}', value)} || {after}", False)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    redactor = Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT), rules)
    return redactor, redactor.tokenize(rows, "c_custkey", "text")


@query(
    "tokenize_github",
    f"""SELECT c_custkey, 'é leak ' || CASE WHEN c_custkey % 3 = 0 THEN {expression(PLANTS["vcs.github"][2], True)}
ELSE {expression(token_sql("github_token", PLANTS["vcs.github"][1], 32), True)} END || ' end' AS text FROM customer""",
)
def tokenize_github(spark, sf_dir):
    return tokenized(spark, sf_dir, "vcs.github")[1].rows


for _name in ("vcs.github", "secrets.connection_string", "contact.email", "network.ipv4", "network.ipv6", "network.mac", "secrets.pem_key", "contact.phone"):

    def _trip(spark, sf_dir, name=_name):
        redactor, done = tokenized(spark, sf_dir, name)
        return redactor.detokenize(done.rows, "text")

    query(f"roundtrip_{_name.replace('.', '_')}", f"SELECT c_custkey, {planted_text(_name, True)} AS text FROM customer")(_trip)


@query(
    "roundtrip_every_entity",
    "SELECT c_custkey, true AS hidden, "
    + expression(by_row([f"{b} || CASE WHEN c_custkey % 3 = 0 THEN {stays} ELSE {RESTORED.get(n, v)} END || {a}" for n, (b, v, stays, a) in PLANTS.items()]), True)
    + " AS text FROM customer",
)
def roundtrip_every_entity(spark, sf_dir):
    """All detectors at work on a form of each: values are gone from the tokenized text, and back after restoring."""
    value = F.expr(expression(by_row([v for _, v, _, _ in PLANTS.values()]), False))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(by_row([planted_text(n) for n in PLANTS])).alias("text"), value.alias("value"))
    redactor = Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT))
    done = redactor.tokenize(rows, "c_custkey", "text").rows.withColumn("hidden", (F.col("c_custkey") % 3 == 0) | ~F.contains("text", F.col("value")))
    return redactor.detokenize(done, "text").select("c_custkey", "hidden", "text")


#: Values of the small spaces beside a text of the form of their own placeholders: (value, what it is restored to, that text).
STANDING = (
    (PLANTS["contact.phone"][1], None, "'415-555-01' || substr({D}, 5, 2)"),
    (PLANTS["contact.intl_phone"][1], RESTORED["contact.intl_phone"], "'+1-555-12' || substr({D}, 5, 2)"),
    (PLANTS["india_pii.aadhaar"][1], RESTORED["india_pii.aadhaar"], "'0000 1234 56' || substr({D}, 5, 2)"),
    (PLANTS["india_pii.pan"][1], None, "'FAKEP12' || substr({D}, 5, 2) || 'Z'"),
    (PLANTS["network.mac"][1], None, "'02:00:00:aa:bb:' || substr({H}, 20, 2)"),
)


@query("roundtrip_standing", "SELECT c_custkey, " + expression(by_row([f"{v if back is None else back} || ' or ' || {own}" for v, back, own in STANDING]), True) + " AS text FROM customer")
def roundtrip_standing(spark, sf_dir):
    """A text that looks like a placeholder is never minted for a value of the batch, so restoring leaves it as it was."""
    text = expression(by_row([f"{v} || ' or ' || {own}" for v, _, own in STANDING]), False)
    redactor = Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    return redactor.detokenize(redactor.tokenize(rows, "c_custkey", "text").rows, "text")


def whole_table_trip(name: str, key: str, text: str):
    def run(spark, sf_dir):
        """All detectors over whole texts, and all values back. The vault goes on in 240.x.y: a large table has over 512 networks."""
        redactor = Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT, extended=True))
        return redactor.detokenize(redactor.tokenize(table(spark, sf_dir, name).select(*key.split(", "), text), key.partition(",")[0], text).rows, text)

    query(f"roundtrip_{name}", f"SELECT {key}, {text} FROM {name}")(run)


for _table, _key, _text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id, turn", "text")):
    whole_table_trip(_table, _key, _text)


@query("detect_documents")
def detect_documents(spark, sf_dir):
    """What all detectors find in whole documents. No SQL: the tests hold the scan against the detectors one by one."""
    names = F.array(*[F.lit(d.name) for d in DETECTORS])
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(detect.scan(F.col("text"), Compiled())["dets"]).alias("d"))
    return found.select("doc_id", F.get(names, F.col("d.det_ord")).alias("detector"), "d.start", "d.end", F.expr("substring(text, d.start + 1, d.end - d.start)").alias("value"))


HOST_OF = "'acme' || c_custkey || '.org'"
HOST_TOKEN = token_sql("domain", HOST_OF, 16)


@query(
    "keep_unknown_paths",
    f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'box/' || {HOST_TOKEN} || '.org and ' || {HOST_TOKEN} || '.org' ELSE 'box/' || {HOST_OF} END AS text FROM customer",
)
def keep_unknown_paths(spark, sf_dir):
    """A host in a path is replaced only if the text or the vault knows it otherwise."""
    text = f"'box/' || {HOST_OF} || CASE WHEN c_custkey % 2 = 0 THEN ' and ' || {HOST_OF} ELSE '' END"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    return Redactor(spark, Vault(spark, shared_path(spark, "vault"), salt=SALT)).tokenize(rows, "c_custkey", "text").rows


SECRET = f"'pw-' || {expression('substr({H}, 1, 12)', True)}"


@query("known_values", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'so ' || {token_sql('password', SECRET, 24)} || '!' ELSE 'so x' || {SECRET} END AS text FROM customer")
def known_values(spark, sf_dir):
    """A value that only its label gave away is found without it in a later batch, where it stands alone. No other detector
    is at work: some of the planted texts hold twelve digits that pass for an Aadhaar number."""
    redactor, _ = tokenized(spark, sf_dir, "secrets.password", "CASE WHEN false THEN {stays} ELSE {value} END", only("secrets.password"))
    text = expression("CASE WHEN c_custkey % 2 = 0 THEN 'so pw-' || substr({H}, 1, 12) || '!' ELSE 'so xpw-' || substr({H}, 1, 12) END", False)
    return redactor.tokenize(table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text")), "c_custkey", "text").rows


@query(
    "tokenize_twice",
    f"""SELECT c_custkey, 'é leak ' || CASE WHEN c_custkey % 3 = 0 THEN {expression(PLANTS["vcs.github"][2], True)}
ELSE {expression(token_sql("github_token", PLANTS["vcs.github"][1], 32), True)} END || ' end' AS text FROM customer""",
)
def tokenize_twice(spark, sf_dir):
    """Placeholders of earlier batches are never detected anew."""
    redactor, done = tokenized(spark, sf_dir, "vcs.github")
    return redactor.tokenize(done.rows, "c_custkey", "text").rows


@query("audit_events", f"SELECT 'replacement' AS event, 'tokenize' AS direction, {expression(PLANTS['vcs.github'][1], True)} AS real, {expression(token_sql('github_token', PLANTS['vcs.github'][1], 32), True)} AS token, 'github_token' AS entity_type, {expression(token_sql('github_token', PLANTS['vcs.github'][1], 32), True)} AS wire_value FROM customer WHERE c_custkey % 3 <> 0")
def audit_events(spark, sf_dir):
    return tokenized(spark, sf_dir, "vcs.github")[1].audit
