"""The engine's operators as queries over the star tables, each with the SQL that says the same. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import jsonx, money, text
from .operators import catalog, chain, polling, revision, schedule
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What an unfenced program must show, in these queries.
MARKERS = ("AlgorithmBase",)
ALLOWED = ["PROMO", "STANDARD", "NO SUCH TYPE", "PROMO"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events")


def _verdict(c: Column) -> Column:
    return F.when(c == "purchase", "ok").when(c == "error", "fail")


_POLL = """
WITH seen AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
cut AS (SELECT * FROM seen WHERE n <= {limit}),
done AS (SELECT user_id, min(n) AS n FROM cut WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
most AS (SELECT user_id, max(n) AS n FROM cut GROUP BY user_id)
SELECT m.user_id, CASE c.event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'timeout' END AS outcome, coalesce(d.n, m.n) AS polls, c.event_id
FROM most m LEFT JOIN done d ON d.user_id = m.user_id LEFT JOIN cut c ON c.user_id = d.user_id AND c.n = d.n"""


@query(_POLL.format(limit=60))
def poll_until_terminal(spark, sf_dir):
    return polling.poll_until_terminal(_events(spark, sf_dir), "user_id", ["ts", "event_id"], _verdict(F.col("event_type"))).drop("ts")


@query(_POLL.format(limit=2))
def poll_timeout(spark, sf_dir):
    return polling.poll_until_terminal(_events(spark, sf_dir), "user_id", ["ts", "event_id"], _verdict(F.col("event_type")), limit=2).drop("ts")


_STATUS = "CASE event_id % 6 WHEN 0 THEN 'Incomplete' WHEN 1 THEN 'Completed with error' WHEN 2 THEN 'Runtime ERROR' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'In queue' ELSE event_type END"


@query(f"""SELECT event_id, s AS status, CASE WHEN regexp_matches(lower(s), 'complete|finished|success') THEN 'ok' WHEN regexp_matches(lower(s), 'error|failed|cancel') THEN 'fail' END AS verdict,
CASE WHEN s IN ('Runtime ERROR', 'Cancelled', 'Incomplete', 'Completed with error', 'error') THEN 'fail' END AS strict FROM (SELECT event_id, {_STATUS} AS s FROM events)""")
def status_classify(spark, sf_dir):
    s = _events(spark, sf_dir).select("event_id", F.expr(_STATUS).alias("status"))
    return s.select("*", polling.classify_status(F.col("status")).alias("verdict"), polling.strict_status(F.col("status")).alias("strict"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'BuildSuccess' WHEN 'error' THEN 'BuildError' ELSE 'Building' END"


@query(f"SELECT user_id, min(CASE WHEN s = 'BuildSuccess' THEN 'ok' WHEN s = 'BuildError' THEN 'fail' END) FILTER (s <> 'Building') AS best, count(*) FILTER (s = 'Building') AS waiting FROM (SELECT user_id, {_STATE} AS s FROM events) GROUP BY user_id".replace("min(CASE", "max(CASE"))
def build_states(spark, sf_dir):
    v = polling.classify_build(F.expr(_STATE))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max(v).alias("best"), F.count_if(v.isNull()).alias("waiting"))


@query(_POLL.format(limit=60).replace("'purchase', 'error'", "'purchase', 'error', 'signup'").replace("WHEN 'error' THEN 'fail'", "WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'fail'"))
def build_poll(spark, sf_dir):
    state = F.when(F.col("event_type").isin("purchase", "signup"), "BuildSuccess").when(F.col("event_type") == "error", "BuildError").otherwise("InQueue")
    return polling.poll_until_terminal(_events(spark, sf_dir), "user_id", ["ts", "event_id"], polling.classify_build(state)).drop("ts")


_RESPONSE = """CASE event_id % 12 WHEN 0 THEN 'Error executing tool read_backtest: ' || event_type WHEN 1 THEN '{"error": "' || event_type || '"}' WHEN 2 THEN '{"status": "' || event_type || ' Completed", "p": ' || props || '}'
WHEN 3 THEN '{"backtest": {"status": "' || event_type || '"}, "totalTrades": ' || (user_id % 3) || '}' WHEN 4 THEN '{"completed": ' || CASE WHEN value > 20 THEN 'true' ELSE '"true"' END || '}' WHEN 5 THEN '{"statistics": ' || props || '}' WHEN 6 THEN '{"status": "Running", "error": ""}'
WHEN 7 THEN '{"status": ' || (user_id % 2) || ', "charts": [1]}' WHEN 8 THEN '{"backtest": null, "error": ' || CASE WHEN value > 20 THEN 'null' ELSE '"false"' END || '}' WHEN 9 THEN '{"status": 0, "error": "0"}' WHEN 10 THEN '["Completed"]'
ELSE '{"state": "", "backtest": {"totalTrades": ' || (user_id % 2) || ', "state": "' || event_type || '"}}' END"""
#: The rules on a JSON value, in DuckDB.
_DUCK_TRUE = "coalesce(CASE json_type({0}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN ({0})::VARCHAR = 'true' WHEN 'VARCHAR' THEN ({0})->>'$' <> '' WHEN 'ARRAY' THEN json_array_length({0}) > 0 WHEN 'OBJECT' THEN len(json_keys({0})) > 0 ELSE ({0})::DOUBLE <> 0 END, false)"


def _duck_true(path: str, of: str = "j") -> str:
    return _DUCK_TRUE.format(f"json_extract({of}, '{path}')")


def _duck_lookup(paths: tuple[str, ...], of: str = "j") -> str:
    """The first value that counts, as JSON; 'broken' (no JSON of an object's field) where the lookup fails."""
    cases = []
    for path in paths:
        parent = path.rpartition(".")[0]
        if parent != "$":
            cases.append(f"WHEN json_type(json_extract({of}, '{parent}')) <> 'OBJECT' THEN 'broken'")
        cases.append(f"WHEN {_duck_true(path, of)} THEN json_extract({of}, '{path}')::VARCHAR")
    return f"CASE {' '.join(cases)} END"


_DUCK_DONE = " OR ".join([f"coalesce(json_extract(j, '{at}.{k}')::VARCHAR = 'true', false)" for at in ("$", "$.backtest") for k in ("completed", "finished")] + [_duck_true(f"{at}.{k}") for at in ("$", "$.backtest") for k in jsonx.RESULT_KEYS])


@query(f"""WITH r AS (SELECT event_id, {_RESPONSE} AS raw FROM events), p AS (SELECT *, CASE WHEN raw[1] = '{{' THEN raw ELSE '{{}}' END::JSON AS j FROM r), s AS (SELECT *, {_duck_lookup(jsonx.STATUS_PATHS)} AS status FROM p)
SELECT event_id, CASE WHEN starts_with(raw, 'Error executing tool read_backtest') THEN 'fail' WHEN status = 'broken' OR status[1] <> '"' THEN 'fail' WHEN {_duck_true("$.error")} THEN 'fail'
WHEN regexp_matches(lower(status), 'complete|finished|success') THEN 'ok' WHEN regexp_matches(lower(status), 'error|failed|cancel') THEN 'fail' WHEN {_DUCK_DONE} THEN 'ok' END AS verdict FROM s""")
def response_classify(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.expr(_RESPONSE).alias("raw")).select("event_id", polling.classify_response(F.col("raw"), literals=False).alias("verdict"))


_REPLY = """CASE doc_id % 6 WHEN 0 THEN 'Here:\\n```python\\n' || text || '\\n```\\nDone' WHEN 1 THEN 'Here:\\n```\\ndef run(): pass\\n' || text || '\\n```' WHEN 2 THEN 'Sure\\nimport base\\n' || text || '\\nclass A(AlgorithmBase): pass  '
WHEN 3 THEN 'Sure\\nimport base\\n' || text WHEN 4 THEN 'Here:\\n```\\n' || text || '\\n```\\n' ELSE text END"""
_DUCK_SPACE = "'^[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x1c-\\x1f]+'"


def _duck_strip(of: str) -> str:
    return f"regexp_replace(regexp_replace({of}, {_DUCK_SPACE}, '', 'g'), {_DUCK_SPACE.replace(chr(39) + '^', chr(39)).replace(']+' + chr(39), ']+$' + chr(39))}, '', 'g')"


@query(f"""WITH r AS (SELECT doc_id, {_REPLY.replace("'Here", "E'Here").replace("'Sure", "E'Sure").replace("|| '", "|| E'")} AS reply FROM documents),
p AS (SELECT *, {_duck_strip("regexp_extract(reply, '```python\\s*\\n(.*?)```', 1, 's')")} AS fenced, {_duck_strip("regexp_extract(reply, '```\\s*\\n(.*?)```', 1, 's')")} AS bare, {_duck_strip("regexp_extract(reply, '(?ms)^[ \\t]*(?:from|import|class|def) [^\\n]*[^\\s].*')")} AS loose FROM r)
SELECT doc_id, CASE WHEN regexp_matches(reply, '```python\\s*\\n(.*?)```', 's') THEN fenced WHEN regexp_matches(reply, '```\\s*\\n(.*?)```', 's') AND regexp_matches(bare, '(import|from|def|class) ') THEN bare WHEN contains(loose, 'AlgorithmBase') THEN loose END AS code FROM p""")
def extract_code(spark, sf_dir):
    reply = tables.read(spark, sf_dir, "documents").select("doc_id", F.expr(_REPLY).alias("reply"))
    return reply.select("doc_id", text.extract_code(F.col("reply"), MARKERS).alias("code"))


_BUILD_LOG = "text || CASE doc_id % 4 WHEN 0 THEN '\\nError: boom ' || source || '\\nat line ' || doc_id || ': bad\\nERROR\\tboom ' || source WHEN 1 THEN '\\nbuild: CS' || doc_id || ': gone ' || lang || '\\nCS12 ' || lang WHEN 2 THEN '\\nerror:\\n\\n next ' || lang ELSE '' END"


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i AND x <> '')"


_FOUND = " || ".join(f"regexp_extract_all(raw, '(?i){mark}[\\s:]+([^\\n]+)', 1)" for mark in ("error", "CS[0-9]+", "line [0-9]+"))


@query(f"""WITH r AS (SELECT doc_id, {_BUILD_LOG.replace("'" + chr(92) + "n", "E'" + chr(92) + "n").replace("': bad", "E': bad").replace("': gone", "E': gone")} AS raw FROM documents),
f AS (SELECT doc_id, list_transform({_FOUND}, lambda x: {_duck_strip("x")}) AS found FROM r), d AS (SELECT doc_id, {_distinct("found")} AS found FROM f)
SELECT doc_id, CASE WHEN len(found) > 0 THEN found ELSE ['Compilation failed - no specific error extracted'] END AS errors FROM d""")
def extract_errors(spark, sf_dir):
    raw = tables.read(spark, sf_dir, "documents").select("doc_id", F.expr(_BUILD_LOG).alias("raw"))
    return raw.select("doc_id", text.error_messages(F.col("raw")).alias("found")).select("doc_id", text.with_default(F.col("found"), text.NO_ERROR_TEXT).alias("errors"))


_SHAPES = """CASE event_id % 7 WHEN 0 THEN '{"backtestId": "b' || user_id || '"}' WHEN 1 THEN '{"backtestId": "", "id": "i' || user_id || '"}' WHEN 2 THEN '{"backtest": {"backtestId": "n' || user_id || '", "status": "Running"}}'
WHEN 3 THEN '{"result": {"backtestId": ' || user_id || '}, "state": "' || event_type || '"}' WHEN 4 THEN '{"id": 0, "backtest": "' || event_type || '", "status": ""}' WHEN 5 THEN '{"id": "0", "status": false}' ELSE 'text backtestId = "ab12' || user_id || '" end' END"""


def _plain(of: str) -> str:
    return f"CASE WHEN {of} = 'broken' THEN NULL WHEN {of}[1] = '\"' THEN ({of})::JSON->>'$' ELSE {of} END"


@query(f"""WITH r AS (SELECT event_id, {_SHAPES} AS raw FROM events), p AS (SELECT *, CASE WHEN raw[1] = '{{' THEN raw END::JSON AS j FROM r), f AS (SELECT *, {_duck_lookup(jsonx.ID_PATHS)} AS a, {_duck_lookup(jsonx.STATUS_PATHS)} AS b FROM p)
SELECT event_id, CASE WHEN a = 'broken' THEN NULL ELSE coalesce({_plain("a")}, nullif(regexp_extract(raw, 'backtestId["'']?\\s*[:=]\\s*["'']([0-9a-fA-F]+)["'']', 1), '')) END AS id, {_plain("b")} AS status FROM f""")
def id_coalesce(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.expr(_SHAPES).alias("raw"))
    return e.select("event_id", jsonx.resolved_backtest_id(F.col("raw"), text.backtest_id(F.col("raw"))).alias("id"), jsonx.status(F.col("raw")).alias("status"))


_ARGUMENTS = """CASE event_id % 5 WHEN 0 THEN '{"projectId": "p' || user_id || '"}' WHEN 1 THEN '{"projectId": 0, "model": {"projectId": "m' || user_id || '"}}' WHEN 2 THEN '{"model": ' || props || '}' WHEN 3 THEN '{"model": ' || user_id || '}' ELSE '[' || props END"""


@query(f"""WITH f AS (SELECT event_id, {_duck_lookup(jsonx.PROJECT_PATHS)} AS a FROM (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END::JSON AS j FROM (SELECT event_id, {_ARGUMENTS} AS raw FROM events))) SELECT event_id, {_plain("a")} AS project_id FROM f""")
def project_from_arguments(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", jsonx.project_id(F.expr(_ARGUMENTS)).alias("project_id"))


_CALL = """CASE event_type WHEN 'error' THEN 'create_backtest' WHEN 'click' THEN 'create_backtest' WHEN 'signup' THEN 'delete_all' ELSE 'read_file' END"""


@query(f"""WITH r AS (SELECT event_id, {_CALL} AS tool, {_ARGUMENTS} AS arguments, {_SHAPES} AS raw, {_RESPONSE} AS report, CASE user_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' WHEN 2 THEN 'timeout' END AS polled FROM events),
p AS (SELECT *, CASE WHEN raw[1] = '{{' THEN raw ELSE '{{}}' END::JSON AS j, CASE WHEN json_valid(arguments) THEN arguments END::JSON AS g, CASE WHEN json_valid(report) THEN report END::JSON AS t FROM r),
f AS (SELECT *, {_duck_lookup(jsonx.ID_PATHS)} AS a, {_duck_lookup(jsonx.PROJECT_PATHS, "g")} AS b, {_duck_lookup(("$.error",), "t")} AS c, {_duck_lookup(jsonx.STATUS_PATHS, "t")} AS d FROM p),
h AS (SELECT *, CASE WHEN tool = 'delete_all' THEN 1 WHEN g IS NULL THEN 2 WHEN tool <> 'create_backtest' THEN 3 WHEN coalesce(a, '') = 'broken' OR coalesce(b, '') = 'broken' THEN 4
WHEN coalesce({_plain("a")}, nullif(regexp_extract(raw, 'backtestId["'']?\\s*[:=]\\s*["'']([0-9a-fA-F]+)["'']', 1), '')) IS NULL THEN 5 WHEN b IS NULL THEN 6 WHEN polled = 'timeout' THEN 7 WHEN polled = 'fail' THEN 8 WHEN polled = 'ok' THEN 9 ELSE 10 END AS n FROM f)
SELECT event_id, CASE WHEN n IN (3, 9) THEN true WHEN n < 10 THEN false END AS ok, CASE n WHEN 1 THEN 'Tool ''delete_all'' not in list' WHEN 2 THEN 'arguments are not JSON' WHEN 4 THEN 'response is of another shape' WHEN 5 THEN 'No backtestId' WHEN 6 THEN 'No projectId' WHEN 7 THEN 'Backtest timeout'
WHEN 8 THEN coalesce({_plain("c")}, {_plain("d")}, report) END AS error, CASE WHEN n IN (3, 5, 6, 10) THEN j::VARCHAR WHEN n IN (8, 9) THEN report END AS data, CASE n WHEN 5 THEN raw END AS raw, CASE n WHEN 1 THEN 2 END AS available FROM h""")
def call_envelope(spark, sf_dir):
    polled = F.when(F.col("user_id") % 4 == 0, "ok").when(F.col("user_id") % 4 == 1, "fail").when(F.col("user_id") % 4 == 2, "timeout")
    e = _events(spark, sf_dir).select("event_id", *[F.expr(x).alias(n) for n, x in (("tool", _CALL), ("arguments", _ARGUMENTS), ("raw", _SHAPES), ("report", _RESPONSE))], polled.alias("polled"))
    names = F.array(F.lit("create_backtest"), F.lit("read_file"))
    answer = polling.envelope(*[F.col(c) for c in ("tool", "arguments", "raw")], names, F.col("polled"), F.col("report"))
    return e.select("event_id", answer.alias("e")).select("event_id", "e.ok", "e.error", "e.data", "e.raw", F.when(F.col("e.available").isNotNull(), F.size("e.available")).alias("available"))


_KINDS = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN left(props, length(props) - 1) WHEN 3 THEN '' ELSE '{''k'': None, ''u'': ' || user_id || '}' END"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'invalid' WHEN 3 THEN 'empty' ELSE 'invalid' END AS kind,
CASE event_id % 5 WHEN 0 THEN json_extract_string(props, '$.k') END AS k, CASE event_id % 5 WHEN 4 THEN user_id::VARCHAR END AS u, CASE event_id % 5 WHEN 1 THEN 'arguments are not an object' WHEN 2 THEN 'arguments are not JSON' WHEN 4 THEN 'arguments are not JSON' END AS complaint FROM events""")
def safe_parse(spark, sf_dir):
    raw = F.expr(_KINDS)
    e = _events(spark, sf_dir).select("event_id", raw.alias("raw")).select("event_id", "raw", jsonx.safe_object(F.col("raw")).alias("o"))
    return e.select("event_id", jsonx.kind(F.col("raw")).alias("kind"), F.get_json_object("o", "$.k").alias("k"), F.get_json_object("o", "$.u").alias("u"), jsonx.argument_error(F.col("raw")).alias("complaint"))


_BUILD = """CASE event_id % 8 WHEN 0 THEN '{"errors": [" a ' || event_type || '", "b", "b", "", ' || props || '], "state": "BuildError"}' WHEN 1 THEN '{"compile": {"logs": ["log ' || user_id || '"]}, "error": "' || event_type || '", "state": "BuildError", "message": "why"}'
WHEN 2 THEN '{"state": "BuildSuccess", "message": "fine"}' WHEN 3 THEN '{"errors": "one", "message": "not told"}' WHEN 4 THEN '{"error": null, "errors": [null, true, ' || user_id || ']}' WHEN 5 THEN '{"error": ["' || event_type || '","x"], "state": "error"}' WHEN 6 THEN '[' || props || ']'
ELSE 'Error: ' || event_type || ' in CS' || user_id || ': gone' END"""
_SAID = "CASE json_type({0}) WHEN 'VARCHAR' THEN ({0})->>'$' WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE ({0})::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END ELSE ({0})::VARCHAR END"


def _duck_one(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') IS NULL THEN [] ELSE [{_SAID.format(f'json_extract(j, {chr(39)}{path}{chr(39)})')}] END"


def _duck_many(path: str) -> str:
    return f"CASE json_type(j, '{path}') WHEN 'ARRAY' THEN list_transform(json_extract(j, '{path}')::JSON[], lambda y: {_SAID.format('coalesce(y, ' + chr(39) + 'null' + chr(39) + '::JSON)')}) WHEN 'VARCHAR' THEN {_duck_one(path)} ELSE [] END"


@query(f"""WITH r AS (SELECT event_id, {_BUILD} AS raw FROM events), p AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END::JSON AS j FROM r),
f AS (SELECT event_id, list_transform(CASE WHEN j IS NULL THEN {_FOUND} ELSE {_duck_many("$.errors")} || {_duck_many("$.compile.logs")} || {_duck_one("$.error")} || CASE WHEN contains(lower(coalesce(json_extract_string(j, '$.state'), '')), 'error') THEN {_duck_one("$.message")} ELSE [] END END, lambda x: trim(x)) AS found FROM p),
d AS (SELECT event_id, {_distinct("found")} AS found FROM f), e AS (SELECT event_id, CASE WHEN len(found) > 0 THEN found ELSE ['Compilation failed - no specific error extracted'] END AS errors FROM d)
SELECT event_id, errors, array_to_string(list_transform(errors[1:10], lambda x: '  - ' || x), chr(10)) AS bullets FROM e""")
def compile_errors(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.expr(_BUILD).alias("raw"))
    return e.select("event_id", jsonx.let(jsonx.compile_errors(F.col("raw")), lambda x: F.struct(x.alias("errors"), text.bullets(x).alias("bullets"))).alias("r")).select("event_id", "r.*")


@query("SELECT doc_id, coalesce(text[1:100], '') || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS task, coalesce(text[1:500], '') AS head FROM documents")
def previews(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 100).alias("task"), text.shortened(F.col("text"), 500, "").alias("head"))


@query(f"""WITH p AS (SELECT event_id, CASE WHEN raw[1] = '{{' THEN raw END::JSON AS j FROM (SELECT event_id, {_RESPONSE} AS raw FROM events)), f AS (SELECT *, {_duck_lookup(jsonx.TRADE_PATHS)} AS n FROM p)
SELECT event_id, array_to_string(list_sort(json_keys(j)), ',') AS names, CASE WHEN json_type(j, '$.status') IS NULL THEN 'unknown' WHEN json_type(j, '$.status') = 'VARCHAR' THEN j->>'$.status' ELSE (j->'$.status')::VARCHAR END AS status, coalesce(try_cast(n AS INT), 0) AS trades FROM f""")
def response_fields(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.expr(_RESPONSE).alias("raw"))
    return e.select("event_id", F.array_join(jsonx.keys(F.col("raw")), ",").alias("names"), jsonx.get(F.col("raw"), "$.status", F.lit("unknown")).alias("status"), jsonx.total_trades(F.col("raw")).alias("trades"))


@query("SELECT event_id, event_type || chr(10) || props || chr(10) || user_id AS text FROM events")
def flatten_blocks(spark, sf_dir):
    none = F.lit(None).cast("string")
    block = lambda t=none, d=none, m=none, o=none: F.struct(t.alias("text"), d.alias("data"), m.alias("model"), o.alias("other"))
    blocks = F.array(block(F.col("event_type")), block(F.lit(""), F.col("props")), block(o=F.col("user_id").cast("string")))
    return _events(spark, sf_dir).select("event_id", jsonx.flatten_blocks(blocks).alias("text"))


def _sql_list(names) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


@query(f"SELECT l.ord::INT AS ord, l.name FROM (VALUES {_sql_list(ALLOWED)}) l(ord, name) WHERE l.name IN (SELECT p_type FROM part)")
def tool_allowlist(spark, sf_dir):
    return catalog.allowed(catalog.allow_list(spark, ALLOWED), tables.read(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


_NATIONS = ["NATION_7", "NATION_2", "ATLANTIS", "NATION_20"]


@query(f"SELECT l.ord::INT AS ord, l.name, CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name || ' tool' ELSE '' END AS description, CASE WHEN n.n_regionkey > 1 THEN 'r' || n.n_regionkey ELSE '{{}}' END AS input_schema FROM (VALUES {_sql_list(_NATIONS)}) l(ord, name) JOIN nation n ON n.n_name = l.name")
def tool_cards(spark, sf_dir):
    tools = tables.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" tool"))).alias("description"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("r"), "n_regionkey")).alias("input_schema"))
    return catalog.cards(catalog.allow_list(spark, _NATIONS), tools)


@query("SELECT c_custkey, c_mktsegment AS name, 'BUILDING, MACHINERY' AS available FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def refused_tools(spark, sf_dir):
    calls = tables.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    return catalog.refused(calls, catalog.allow_list(spark, ["BUILDING", "MACHINERY"])).select("c_custkey", "name", "available")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY n) AS types FROM (SELECT user_id, event_type, min(n) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return _events(spark, sf_dir).groupBy("user_id").agg(rows.alias("r")).select("user_id", F.array_join(text.ordered_distinct(F.transform("r", lambda x: F.concat(F.lit(" "), x["event_type"], F.lit("\t")))), ",").alias("types"))


@query("SELECT user_id, list(event_type ORDER BY event_type) AS fingerprint FROM events GROUP BY user_id")
def error_fingerprint(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(revision.fingerprint(F.collect_list("event_type")).alias("fingerprint"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def catalog_last_wins(spark, sf_dir):
    return catalog.last_wins(_events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, string_agg('  - ' || event_type, chr(10) ORDER BY n) FILTER (n <= 10) AS bullets, string_agg(event_type, ', ' ORDER BY n) FILTER (n <= 3) || CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS preview FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id")
def error_bullets(spark, sf_dir):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return _events(spark, sf_dir).groupBy("user_id").agg(rows.alias("r")).select("user_id", text.bullets(F.col("r")).alias("bullets"), text.preview(F.col("r")).alias("preview"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') < 12 AND count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AS success FROM events GROUP BY user_id")
def success_gate(spark, sf_dir):
    flags = _events(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") < 12).alias("c"), (F.count_if(F.col("event_type") == "signup") > 0).alias("b"), F.count_if(F.col("event_type") == "purchase").alias("t"))
    return flags.select("user_id", revision.succeeded(F.col("c"), F.col("b"), F.col("t")).alias("success"))


_ATTEMPTS = """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt, event_id % 11 = 0 AS raised, event_id % 7 <> 0 AS submitted, event_type NOT IN ('error', 'signup') AS compile_ok, event_type <> 'view' AS backtest_ok,
CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INT) % 3 ELSE 0 END AS trades, event_type AS message, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'p' || event_id END AS project_id, event_id % 3 <> 0 AS changed FROM events"""


@query(f"""WITH RECURSIVE a AS ({_ATTEMPTS}), f(user_id, n, outcome, final, revisions, project, seen) AS (
SELECT DISTINCT user_id, 0, '', NULL::INT, 0, '', ''::VARCHAR FROM a
UNION ALL SELECT f.user_id, f.n + 1,
CASE WHEN f.outcome <> '' OR a.raised OR NOT a.submitted THEN f.outcome WHEN a.compile_ok AND a.backtest_ok AND a.trades > 0 THEN 'success' WHEN f.revisions >= 3 THEN 'revisions' WHEN NOT a.compile_ok AND contains(f.seen, '<' || a.message || '>') THEN 'repeated' ELSE '' END,
CASE WHEN f.outcome <> '' OR a.raised OR NOT a.submitted THEN f.final WHEN (a.compile_ok AND a.backtest_ok AND a.trades > 0) OR f.revisions >= 3 OR (NOT a.compile_ok AND contains(f.seen, '<' || a.message || '>')) THEN a.attempt ELSE f.final END,
CASE WHEN f.outcome <> '' OR a.raised OR NOT a.submitted OR (a.compile_ok AND a.backtest_ok AND a.trades > 0) OR f.revisions >= 3 OR (NOT a.compile_ok AND contains(f.seen, '<' || a.message || '>')) THEN f.revisions WHEN (NOT a.compile_ok OR a.trades = 0) AND a.changed THEN f.revisions + 1 ELSE f.revisions END,
CASE WHEN f.outcome <> '' OR a.raised OR NOT a.submitted OR a.project_id = '' THEN f.project ELSE a.project_id END,
CASE WHEN f.outcome <> '' OR a.raised OR NOT a.submitted OR (a.compile_ok AND a.backtest_ok AND a.trades > 0) OR f.revisions >= 3 THEN f.seen WHEN NOT a.compile_ok THEN f.seen || '<' || a.message || '>' WHEN a.trades = 0 AND a.changed THEN '' ELSE f.seen END
FROM f JOIN a ON a.user_id = f.user_id AND a.attempt = f.n + 1 WHERE f.n < 8)
SELECT user_id, CASE WHEN outcome = '' THEN 'exhausted' ELSE outcome END AS outcome, final AS final_attempt, revisions, project AS project_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM f) WHERE k = 1""")
def revision_fold(spark, sf_dir):
    _events(spark, sf_dir).createOrReplaceTempView("events")
    a = spark.sql(_ATTEMPTS).withColumn("errors", F.array("message"))
    return revision.fold(a, "user_id", max_attempts=8)


@query("""SELECT event_id, last_value(nullif(p, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS project, event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS changed FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id ELSE '' END AS p FROM events)""")
def sticky_values(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), "event_id")).otherwise(""))
    return e.select("event_id", revision.sticky("user_id", ["ts", "event_id"], "p").alias("project"), revision.changed_code(e, "user_id", ["ts", "event_id"], "event_type").alias("changed"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate::DATE = o_orderdate::DATE GROUP BY l_orderkey")
def same_day_expiry(spark, sf_dir):
    lines, orders = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).where(chain.same_day(F.col("l_shipdate"), F.col("o_orderdate"))).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def _contracts(spark, sf_dir) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot"), F.when(F.col("l_returnflag") == "N", "Call").otherwise("Put").alias("kind"), F.nullif(F.col("l_discount").cast("double"), F.lit(0.0)).alias("delta"), F.col("l_quantity").cast("double").alias("strike"))


_CONTRACTS = "SELECT l_orderkey AS snapshot, CASE WHEN l_returnflag = 'N' THEN 'Call' ELSE 'Put' END AS kind, nullif(l_discount::DOUBLE, 0) AS delta, l_quantity::DOUBLE AS strike FROM lineitem"


@query(f"""SELECT snapshot, count(*) AS contracts, count(*) FILTER (kind = 'Put') AS puts, count(*) FILTER (kind = 'Call') AS calls, count(delta) AS with_delta,
CASE WHEN count(delta) = 0 THEN 'no deltas' WHEN count(*) FILTER (delta > 0.08) = 0 THEN 'no match' ELSE 'tradable' END AS cause FROM ({_CONTRACTS}) GROUP BY snapshot""")
def zero_trade_cause(spark, sf_dir):
    c = _contracts(spark, sf_dir)
    counts = c.groupBy("snapshot").agg(F.count("*").alias("contracts"), F.count_if(F.col("kind") == "Put").alias("puts"), F.count_if(F.col("kind") == "Call").alias("calls"), F.count("delta").alias("with_delta"), F.count_if(F.col("delta") > 0.08).alias("m"))
    return counts.withColumn("cause", chain.no_trade_cause(F.col("contracts"), F.col("with_delta"), F.col("m"))).drop("m")


@query(f"""SELECT snapshot, kind, count(*) AS n, round(sum(strike), 2) AS strikes FROM (SELECT *, max(delta) OVER (PARTITION BY snapshot) IS NOT NULL AS any_delta FROM ({_CONTRACTS}))
WHERE CASE WHEN any_delta THEN delta IS NOT NULL ELSE (kind = 'Put' AND strike < 25 * 0.95) OR (kind = 'Call' AND strike > 25 * 1.05) END GROUP BY snapshot, kind""")
def delta_fallback(spark, sf_dir):
    kept = chain.with_fallback(_contracts(spark, sf_dir), ["snapshot"], F.col("delta"), chain.out_of_the_money(F.col("kind"), F.col("strike"), F.lit(25), 0.05))
    return kept.groupBy("snapshot", "kind").agg(F.count("*").alias("n"), F.round(F.sum("strike"), 2).alias("strikes"))


_PRICE = "SELECT floor(avg(p_retailprice)) AS price FROM part"


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Put' ELSE 'Call' END AS kind FROM part, ({_PRICE}) WHERE (p_size % 2 = 0 AND p_retailprice < price) OR (p_size % 2 = 1 AND p_retailprice > price)")
def otm_filter(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    price = part.agg(F.floor(F.avg("p_retailprice")).alias("price"))
    rows = part.select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 2 == 0, "Put").otherwise("Call").alias("kind")).crossJoin(F.broadcast(price))
    return rows.where(chain.out_of_the_money(F.col("kind"), F.col("p_retailprice"), F.col("price"))).select("p_partkey", "kind")


@query(f"SELECT p_partkey FROM (SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand, p_retailprice > price ORDER BY abs(p_retailprice - price), p_retailprice) AS n FROM part, ({_PRICE})) WHERE n <= 5")
def strike_band(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    price = part.agg(F.floor(F.avg("p_retailprice")).alias("price"))
    return chain.strike_band(part.crossJoin(F.broadcast(price)), ["p_brand"], "p_retailprice", F.col("price"), most=5).select("p_partkey")


@query(f"SELECT p_partkey, CASE WHEN d <= 0.02 THEN 'at the money' WHEN d <= 0.04 THEN '0.25-0.30' WHEN d <= 0.06 THEN '0.15-0.20' WHEN d <= 0.08 THEN '0.10-0.15' ELSE 'below 0.10' END AS band FROM (SELECT p_partkey, abs(p_retailprice::DOUBLE - price) / price AS d FROM part, ({_PRICE}))")
def delta_bands(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p"))
    price = tables.read(spark, sf_dir, "part").agg(F.floor(F.avg("p_retailprice")).alias("price"))
    return part.crossJoin(F.broadcast(price)).select("p_partkey", money.delta_band(F.abs(F.col("p") - F.col("price")) / F.col("price")).alias("band"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1400), p_retailprice, p_partkey) AS n FROM part) WHERE n = 1")
def nearest_strike(spark, sf_dir):
    return chain.nearest(tables.read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", F.lit(1400), ["p_partkey"]).drop("p_retailprice")


def _days(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumn("day", F.to_date("ts"))


@query("""SELECT u.user_id, u.day, max_by(e.event_id, (e.ts, e.event_id)) FILTER (e.ts <= u.day::TIMESTAMP + INTERVAL 10 HOUR) AS event_id FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events) u JOIN events e ON e.user_id = u.user_id AND e.ts::DATE = u.day GROUP BY u.user_id, u.day""")
def snapshot_asof(spark, sf_dir):
    d = _days(spark, sf_dir).select("user_id", "day", "ts", "event_id")
    fires = d.select("user_id", "day").distinct().withColumn("fire_ts", schedule.minutes_after(F.col("day").cast("timestamp_ntz"), 600))
    return chain.as_of(fires, d, ["user_id", "day"], "fire_ts", "ts", ["event_id"]).select("user_id", "day", "event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS snapshot FROM events")
def cached_snapshot(spark, sf_dir):
    return _days(spark, sf_dir).select("event_id", chain.last_non_empty(["user_id", "day"], ["ts", "event_id"], F.when(F.col("event_type") != "view", F.col("event_type"))).alias("snapshot"))


@query("SELECT event_id, ts FROM events WHERE strftime(ts, '%H:%M') BETWEEN '09:45' AND '11:00'")
def entry_window(spark, sf_dir):
    return _events(spark, sf_dir).where(schedule.in_window(F.col("ts"), "09:45", "11:00")).select("event_id", "ts")


@query("SELECT day, event_id FROM (SELECT ts::DATE AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase' AND strftime(ts, '%H:%M') BETWEEN '09:45' AND '11:00') WHERE n = 1")
def one_entry_per_day(spark, sf_dir):
    rows = _days(spark, sf_dir).where((F.col("event_type") == "purchase") & schedule.in_window(F.col("ts"), "09:45", "11:00"))
    return schedule.one_per(rows.select("day", "ts", "event_id"), ["day"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events GROUP BY 1 HAVING max(value) <= 300)")
def vix_gate(spark, sf_dir):
    d = _days(spark, sf_dir)
    return d.select("event_id", "day").join(schedule.calm_days(d, "day", "value", 300.0), "day", "left_semi").select("event_id")


@query("SELECT d::DATE AS day, e.event, d::DATE + e.clock::TIME AS fire_ts FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) r(d), (VALUES ('entry', '10:00'), ('exit', '15:45'), ('reset', '09:31')) e(event, clock) WHERE d <> TIMESTAMP '2024-01-15'")
def schedule_calendar(spark, sf_dir):
    return schedule.calendar(spark, "2024-01-01", "2024-01-30", {"entry": "10:00", "exit": "15:45", "reset": "09:31"}, closed=("2024-01-15",))


@query("""SELECT user_id, day, least(a, b, c) AS exit_ts, CASE WHEN a = least(a, b, c) THEN 'profit' WHEN b = least(a, b, c) THEN 'loss' WHEN c = least(a, b, c) THEN 'time' END AS reason FROM
(SELECT user_id, ts::DATE AS day, min(ts) FILTER (value >= 40) AS a, min(ts) FILTER (event_type = 'error') AS b, min(ts) FILTER (strftime(ts, '%H:%M') >= '15:50') AS c FROM events GROUP BY 1, 2)""")
def exit_first_of(spark, sf_dir):
    return schedule.first_exit(_days(spark, sf_dir), ["user_id", "day"], "ts", {"profit": F.col("value") >= 40, "loss": F.col("event_type") == "error", "time": F.date_format("ts", "HH:mm") >= "15:50"})


@query("SELECT event_id, CASE WHEN n > 3 THEN 'done' WHEN event_type = 'purchase' THEN 'invested' WHEN value > 100 THEN 'not allowed' WHEN user_id % 5 = 0 THEN 'empty cache' ELSE 'enter' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events)")
def entry_gate(spark, sf_dir):
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    d = _days(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return d.select("event_id", schedule.gate(F.col("n") > 3, F.col("event_type") == "purchase", F.col("value") <= 100, F.col("user_id") % 5).alias("outcome"))


@query("SELECT l_partkey, -sum(q) AS quantity, 'End of day' AS tag FROM (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_partkey HAVING sum(q) <> 0")
def closing_positions(spark, sf_dir):
    q = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("bigint")
    return schedule.closing_orders(schedule.positions(tables.read(spark, sf_dir, "lineitem"), ["l_partkey"], q))


@query("SELECT l_returnflag, l_partkey % 10 AS part, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity::BIGINT) AS quantity FROM lineitem GROUP BY 1, 2")
def position_quantity(spark, sf_dir):
    q = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("bigint")
    return schedule.positions(tables.read(spark, sf_dir, "lineitem").withColumn("part", F.col("l_partkey") % 10), ["l_returnflag", "part"], q)


@query("""SELECT o_orderkey, greatest(1, floor((o_custkey - 5)::DOUBLE / 3))::BIGINT AS third, floor(o_totalprice::DOUBLE * 0.02 / nullif(o_custkey % 50, 0))::BIGINT AS capped,
CASE WHEN o_orderpriority = '1-URGENT' THEN 0.65 ELSE 0 END::DOUBLE AS fee, CASE WHEN o_orderpriority = '1-URGENT' THEN round(0.65 * (o_custkey % 7), 2) ELSE 0 END::DOUBLE AS fees FROM orders""")
def sizing_and_fees(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    urgent = {"charged": "1-URGENT"}
    return o.select(
        "o_orderkey", money.third(F.col("o_custkey") - 5).cast("bigint").alias("third"), money.risk_capped(F.col("o_totalprice").cast("double"), F.col("o_custkey") % 50).cast("bigint").alias("capped"),
        money.fee(F.col("o_orderpriority"), F.lit(1), **urgent).cast("double").alias("fee"), F.round(money.fee(F.col("o_orderpriority"), F.col("o_custkey") % 7, per_contract=True, **urgent), 2).cast("double").alias("fees"),
    )


@query("SELECT event_id, round((value - 20) / 20 * sign(event_id % 3 - 1), 6) + 0.0 AS profit FROM events")
def unrealised_profit(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", (F.round(money.profit_percent(F.col("value"), F.lit(20.0), F.col("event_id") % 3 - 1), 6) + F.lit(0.0)).alias("profit"))


@query("SELECT user_id, 'run' || user_id AS projectName, '' AS projectId, n > 60 AS compileOk, 0::INT AS trades, '[]' AS errors, '' AS notes FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def exec_result_json(spark, sf_dir):
    from .sources import results

    runs = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.concat(F.lit("run"), "user_id").alias("project_name"), F.lit(None).cast("string").alias("project_id"), (F.col("n") > 60).alias("compile_ok"))
    j = results.with_defaults(runs).select("user_id", results.to_wire().alias("j"))
    g = lambda k: F.get_json_object("j", f"$.{k}")
    return j.select("user_id", g("projectName").alias("projectName"), g("projectId").alias("projectId"), g("compileOk").cast("boolean").alias("compileOk"), g("trades").cast("int").alias("trades"), g("compileErrors").alias("errors"), g("notes").alias("notes"))


@query("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 'straddle' WHEN 1 THEN 'iron fly' ELSE 'long call' END IN ('long call', 'straddle')) AND event_id % 5 <= 2 AS valid, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN round(value * 1.05, 6) END AS target FROM events")
def spec_validation(spark, sf_dir):
    e = _events(spark, sf_dir)
    conditions = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("c"), (F.col("event_id") % 5).cast("int")))
    kind = F.when(F.col("event_id") % 4 == 0, "straddle").when(F.col("event_id") % 4 == 1, "iron fly").otherwise("long call")
    method = F.when(F.col("event_id") % 3 == 0, "ATM").when(F.col("event_id") % 3 == 1, "OTM").otherwise("delta")
    return e.select("event_id", schedule.valid_spec(kind, conditions).alias("valid"), F.round(schedule.strike_target(method, F.col("value"), F.lit(0.05)), 6).alias("target"))


@query("SELECT event_id, 'The program made no trades. Run report:' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'No additional info' ELSE event_type END || chr(10) || chr(10) || 'Revise this program:' || chr(10) || chr(10) || props AS zero, CASE WHEN event_id % 2 = 0 THEN 'Create project n' ELSE 'Use project ' || user_id END || ' and run:' || chr(10) || chr(10) || props AS run FROM events")
def prompts(spark, sf_dir):
    odd = F.col("event_id") % 2 == 1
    return _events(spark, sf_dir).select("event_id", text.zero_trades_prompt(F.col("props"), F.when(odd, F.col("event_type")).otherwise("")).alias("zero"), text.execution_prompt(F.col("props"), F.lit("n"), F.when(odd, F.col("user_id").cast("string"))).alias("run"))


@query("SELECT user_id, day, event_id, event_type FROM (SELECT user_id, ts::DATE AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_submission(spark, sf_dir):
    return revision.last_submission(_days(spark, sf_dir).select("user_id", "day", "event_id", "event_type"), ["user_id", "day"], "event_id")


@query("SELECT user_id, value AS price FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_price(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.col("value").alias("price"))
    return catalog.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "price")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def date_range(spark, sf_dir):
    return _events(spark, sf_dir).where(schedule.between_days(F.col("ts"), "2024-01-05", "2024-01-10")).select("event_id")


@query("SELECT o_custkey, count(*) AS trades, count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AS urgent FROM orders GROUP BY o_custkey")
def trade_count(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("trades"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


#: Daylight saving time holds from the second Sunday of March, 7:00 UTC, to the first of November, 6:00 UTC.
_SUNDAY = "make_date(year(ts)::INT, {0}, {1}) + ((7 - dayofweek(make_date(year(ts)::INT, {0}, {1}))) % 7)::INT + INTERVAL {2} HOUR"


@query(f"SELECT event_id, strftime(ts - CASE WHEN ts >= {_SUNDAY.format(3, 8, 7)} AND ts < {_SUNDAY.format(11, 1, 6)} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%m-%d %H:%M') AS clock FROM (SELECT event_id, ts + to_days((event_id % 400)::INT) AS ts FROM events)")
def local_clock(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.timestamp_add("DAY", (F.col("event_id") % 400).cast("int"), F.col("ts")).alias("ts"))
    return e.select("event_id", F.date_format(schedule.local_time(F.col("ts")), "MM-dd HH:mm").alias("clock"))


@query("SELECT event_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS held FROM events")
def running_book(spark, sf_dir):
    q = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return _events(spark, sf_dir).select("event_id", schedule.running_position(["user_id"], ["ts", "event_id"], q).alias("held"))


@query("""SELECT event_id, 'Write the algorithm for this specification:' || chr(10) || chr(10) || props AS code, 'The build failed with:' || chr(10) || '  - ' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'Unknown compile error' END || chr(10) || chr(10) || 'Repair this program:' || chr(10) || chr(10) || props AS retry FROM events""")
def build_prompts(spark, sf_dir):
    errors = F.when(F.col("event_id") % 2 == 0, F.array("event_type"))
    return _events(spark, sf_dir).select("event_id", text.code_prompt(F.col("props")).alias("code"), text.retry_prompt(F.col("props"), errors).alias("retry"))


_PICKS = f"SELECT *, CASE snapshot % 3 WHEN 0 THEN 'ATM' WHEN 1 THEN 'OTM' ELSE 'delta' END AS method, l AS line FROM (SELECT c.*, row_number() OVER (PARTITION BY snapshot ORDER BY strike, delta, kind) AS l FROM ({_CONTRACTS}) c)"


@query(f"""SELECT snapshot, strike, delta FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY (method = 'delta' AND delta IS NOT NULL)::INT DESC,
CASE WHEN method = 'delta' AND delta IS NOT NULL THEN abs(abs(delta) - 0.05) WHEN method = 'ATM' THEN abs(strike - 25) ELSE abs(strike - 25 * 1.05) END, strike, coalesce(delta, -1)) AS n FROM ({_PICKS})) WHERE n = 1""")
def strike_pick(spark, sf_dir):
    c = _contracts(spark, sf_dir).withColumn("tie", F.coalesce("delta", F.lit(-1.0)))
    method = F.when(F.col("snapshot") % 3 == 0, "ATM").when(F.col("snapshot") % 3 == 1, "OTM").otherwise("delta")
    return chain.pick(c, ["snapshot"], method, "strike", F.lit(25.0), F.lit(0.05), F.col("delta"), F.lit(0.05), ["tie"]).select("snapshot", "strike", "delta")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate::DATE - o_orderdate::DATE BETWEEN 0 AND 7 GROUP BY l_orderkey")
def expiry_bound(spark, sf_dir):
    lines, orders = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).where(chain.expires_within(F.col("l_shipdate"), F.col("o_orderdate"), 0, 7)).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT event_id FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events GROUP BY 1 HAVING max(value) > 200)")
def high_volatility(spark, sf_dir):
    d = _days(spark, sf_dir)
    return d.select("event_id", "day").join(schedule.volatile_days(d, "day", "value", 200.0), "day", "left_semi").select("event_id")


@query("SELECT event_id, round(1000 + sum(CASE WHEN event_type = 'error' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS equity, value >= 20 AND value <= 100 AS allowed FROM events")
def equity_and_margin(spark, sf_dir):
    flow = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    return _events(spark, sf_dir).select("event_id", F.round(money.running_equity(["user_id"], ["ts", "event_id"], flow, 1000.0), 4).alias("equity"), money.margin_allows(F.col("value"), F.lit(100.0), 0.2).alias("allowed"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'limit' ELSE 'market' END AS kind, user_id % 5 - event_id % 3 AS quantity FROM events WHERE user_id % 5 <> event_id % 3")
def order_kinds(spark, sf_dir):
    e = _events(spark, sf_dir)
    o = schedule.orders(F.col("event_id") % 3, F.col("user_id") % 5, F.when(F.col("event_type") == "view", F.lit(1.5)))
    return e.select("event_id", o.alias("o")).where("o IS NOT NULL").select("event_id", "o.*")
