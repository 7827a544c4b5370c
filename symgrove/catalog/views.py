"""Input views of the registered queries, derived from the given tables.

``SQL_*`` strings are the same views for the SQL side. All cover whole tables;
the groups they build (files per repository, symbols per file) are bounded by
a constant so that their number, not their size, grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from symgrove.catalog.code_templates import BODIES, DEFINITIONS, SHAPES, TEMPLATES, sql_values

REPO_SPAN = 1000
FILE_SPAN = 1000
REQUIRED_FILE = ".sandbox/Dockerfile"
BUDGET = 2500


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), F.col(column) if isinstance(column, str) else column)


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


# --- V1: nodes and edges ---------------------------------------------------

def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    parts = _rows(table(spark, sf_dir, "part"))
    caller = _key("part:", F.col("l_partkey").cast("string"))
    callees = F.array(
        _key("supp:", F.col("l_suppkey").cast("string")),
        _key("part:", ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % parts)
             .cast("string")))
    return item.select(caller.alias("caller_id"), F.explode(callees).alias("callee_id"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without their text: part and supplier symbols."""
    part, supp = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    docs = _rows(table(spark, sf_dir, "documents"))
    kind = (F.when(F.col("p_partkey") % 3 == 0, "function")
            .when(F.col("p_partkey") % 3 == 1, "method").otherwise("class"))
    key = F.col("p_partkey").cast("string")
    return part.select(
        _key("part:", key).alias("node_id"), kind.alias("node_type"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"),
                 F.regexp_replace("p_brand", "#", "_"), F.lit(".py")).alias("file_path"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), key).alias("symbol_name"),
        F.lit("python").alias("language"), (F.col("p_partkey") % docs).alias("doc_id"),
    ).unionByName(supp.select(
        _key("supp:", F.col("s_suppkey").cast("string")).alias("node_id"),
        F.lit("class").alias("node_type"), F.lit("lib/suppliers.go").alias("file_path"),
        F.col("s_name").alias("symbol_name"), F.lit("go").alias("language"),
        (F.col("s_suppkey") % docs).alias("doc_id")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text by the doc_id that symbols name."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_code"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).join(texts(spark, sf_dir), "doc_id").select(
        "node_id", "node_type", "file_path", "symbol_name", "source_code", "language")


SQL_V1 = """
np AS (SELECT count(*) AS n FROM part),
nd AS (SELECT count(*) AS n FROM documents),
edges AS (
  SELECT DISTINCT 'part:'||l_partkey AS caller_id, 'supp:'||l_suppkey AS callee_id FROM lineitem
  UNION
  SELECT DISTINCT 'part:'||l_partkey, 'part:'||((l_partkey*7 + l_linenumber*13) % n)
  FROM lineitem, np),
symbols AS (
  SELECT 'part:'||p_partkey AS node_id,
         CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS node_type,
         'src/'||lower(p_type)||'/'||replace(p_brand,'#','_')||'.py' AS file_path,
         replace(p_name,' ','_')||'_'||p_partkey AS symbol_name, 'python' AS language,
         p_partkey % n AS doc_id
  FROM part, nd
  UNION ALL
  SELECT 'supp:'||s_suppkey, 'class', 'lib/suppliers.go', s_name, 'go', s_suppkey % n
  FROM supplier, nd),
nodes AS (
  SELECT node_id, node_type, file_path, symbol_name, text AS source_code, language
  FROM symbols JOIN documents USING (doc_id))
"""

SQL_V1_RADIUS = SQL_V1 + """,
nbr AS (
  SELECT caller_id AS target_id, 'child' AS role, callee_id AS nbr_id,
         row_number() OVER (PARTITION BY caller_id ORDER BY callee_id) AS pos FROM edges
  UNION ALL
  SELECT callee_id, 'parent', caller_id,
         row_number() OVER (PARTITION BY callee_id ORDER BY caller_id) FROM edges),
lim AS (SELECT * FROM nbr WHERE pos <= CASE role WHEN 'child' THEN 20 ELSE 10 END),
sizes AS (
  SELECT node_id, CAST(length(source_code) AS BIGINT) AS n_len,
         CAST(ceil(length(source_code)/4.0) AS BIGINT) AS n_tok FROM nodes),
radius AS (
  SELECT l.target_id, l.role, l.nbr_id, t.n_tok AS t_tok, n.n_len, n.n_tok
  FROM lim l JOIN sizes t ON t.node_id = l.target_id JOIN sizes n ON n.node_id = l.nbr_id)
"""

SQL_V1_PACK = SQL_V1_RADIUS + """,
run AS (
  SELECT *, CAST(row_number() OVER s AS INT) AS rank,
         sum(n_tok) OVER (s ROWS UNBOUNDED PRECEDING) AS cum
  FROM radius WINDOW s AS (PARTITION BY target_id, role ORDER BY n_len, nbr_id)),
kids AS (SELECT *, t_tok AS base FROM run WHERE role = 'child' AND t_tok <= 2500 AND t_tok + cum <= 2500),
kid_sum AS (SELECT target_id, sum(n_tok) AS kid_tok FROM kids GROUP BY 1),
pars AS (
  SELECT r.*, r.t_tok + coalesce(kid_tok, 0) AS base FROM run r LEFT JOIN kid_sum USING (target_id)
  WHERE r.role = 'parent' AND r.t_tok <= 2500 AND r.t_tok + coalesce(kid_tok, 0) < 2500
    AND r.t_tok + coalesce(kid_tok, 0) + cum <= 2500)
"""


# --- V5: search queries ------------------------------------------------------

_BROAD = ["Widget", "red bolt", "ring.12", "ri ngx", "and", "_19", "small_ring_1", "_1", "%",
          "R", "  ", "a b", "---"]


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad queries, and one per supplier so that the table grows."""
    number = F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 6
    text = (
        F.when(kind == 0, _key("Widget_", number))
        .when(kind == 1, F.concat(F.lit(" \tbolt_"), number, F.lit("\n")))
        .when(kind == 2, _key("ring ", number))
        .when(kind == 3, F.substring("s_name", -2, 2))
        .when(kind == 4, F.col("s_name"))
        .otherwise(F.concat(F.lit("gear."), number, F.lit(" GEAR")))
    )
    own = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 100).alias("qid"), text.alias("query"))
    broad = spark.createDataFrame([(i + 1, q) for i, q in enumerate(_BROAD)],
                                  "qid bigint, query string")
    return broad.unionByName(own)


SQL_V5 = """
q AS (
  SELECT CAST(qid AS BIGINT) AS qid, query FROM (VALUES (1,'Widget'),(2,'red bolt'),(3,'ring.12'),
    (4,'ri ngx'),(5,'and'),(6,'_19'),(7,'small_ring_1'),(8,'_1'),(9,'%'),(10,'R'),(11,'  '),
    (12,'a b'),(13,'---')) v(qid, query)
  UNION ALL
  SELECT s_suppkey + 100, CASE s_suppkey % 6
    WHEN 0 THEN 'Widget_'||s_suppkey WHEN 1 THEN ' '||chr(9)||'bolt_'||s_suppkey||chr(10)
    WHEN 2 THEN 'ring '||s_suppkey WHEN 3 THEN right(s_name, 2) WHEN 4 THEN s_name
    ELSE 'gear.'||s_suppkey||' GEAR' END
  FROM supplier),
norm AS (
  SELECT qid, lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS q FROM q),
live AS (SELECT * FROM norm WHERE q <> '')
"""

SQL_V5_HITS = """
doc AS (SELECT node_id, lower(symbol_name) AS s, greatest(length(symbol_name)-2, 0) AS dl FROM symbols),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc),
ph AS (
  SELECT * FROM (
    SELECT qid, generate_subscripts(p, 1) AS phrase_no, unnest(p) AS phrase
    FROM (SELECT qid, regexp_extract_all(q, '[\\p{L}\\p{N}_]+') AS p FROM live WHERE length(q) >= 3))
  WHERE length(phrase) >= 3),
tf AS (
  SELECT qid, phrase_no, node_id, dl,
         len(list_filter(range(1, CAST(length(s) AS BIGINT)+1),
                         lambda x: substr(s, x, length(phrase)) = phrase)) AS tf
  FROM ph JOIN doc ON contains(s, phrase)),
df AS (SELECT qid, phrase_no, count(*) AS df FROM tf GROUP BY ALL),
ntok AS (SELECT qid, count(*) AS n_phrases FROM ph GROUP BY 1),
sc AS (
  SELECT tf.qid, node_id, count(*) AS hit,
         -sum(CASE WHEN (n-df+0.5)/(df+0.5) > 1 THEN ln((n-df+0.5)/(df+0.5)) ELSE 1e-6 END
              * tf*2.2/(tf + 1.2*(0.25 + 0.75*dl/avgdl))) AS rank
  FROM tf JOIN df USING (qid, phrase_no), st GROUP BY 1, 2),
ranked AS (SELECT sc.qid, node_id, rank FROM sc JOIN ntok USING (qid) WHERE hit = n_phrases),
best AS (SELECT qid, node_id, CAST(pos AS INT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), node_id) AS pos FROM ranked)
  WHERE pos <= 10),
short_hits AS (
  SELECT qid, node_id, CAST(pos AS INT) AS pos FROM (
    SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY length(symbol_name), node_id) AS pos
    FROM live JOIN symbols
      ON translate(symbol_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         LIKE '%'||q||'%'
    WHERE length(q) < 3) WHERE pos <= 10),
hits AS (SELECT * FROM best UNION ALL SELECT * FROM short_hits)
"""

SQL_V5_MATCH = f"{SQL_V1},{SQL_V5},{SQL_V5_HITS}"


# --- V2: files and ignore lines ----------------------------------------------

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, rel_path, content) of every document, and environment files."""
    doc = table(spark, sf_dir, "documents")
    key = F.col("doc_id")

    def pick(modulus: int, values: list[str], other: str) -> Column:
        expr = F.when(key % modulus == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            expr = expr.when(key % modulus == i, value)
        return expr.otherwise(other)

    folder = pick(8, ["node_modules/m", ".git/objects", "_pkg", "src/build", "data/raw"], "src/api")
    stem = F.when(key % 10 == 7, ".hid").when(key % 10 == 6, "__init__").otherwise("f")
    suffix = pick(7, [".py", ".go", ".R", ".r", ".log", ".test.js"], "")
    path = F.concat(folder, F.lit("/"), stem, key.cast("string"), suffix)
    own = doc.select(_repo().alias("repo"), path.alias("rel_path"), F.col("text").alias("content"))
    number = F.substring("source", 4, 9).cast("int")
    envs = doc.where(number % 5 != 0).select(
        _repo().alias("repo"), F.lit(REQUIRED_FILE).alias("rel_path"),
        F.concat(F.lit("FROM image:"), (number % 4).cast("string")).alias("content")).distinct()
    return own.unionByName(envs)


def _repo() -> Column:
    return F.concat(F.col("source"), F.lit("-"),
                    F.floor(F.col("doc_id") / REPO_SPAN).cast("string"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_repo().alias("repo")).distinct()


_IGNORE_LINES = ["# note", "data/", "/_pkg", "*.log", "!keep.log", "  ", "data/", "api/f?1.*",
                 "/src/api/.hid*", " raw \t", "_pkg/x", "foo[", "build\\output", "bin\\Debug", "[^b]1",
                 "f[0-3]*.go", "[z-a]x", "/"]


def ignore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore lines of each repository; every third lacks most of them."""
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("line"))
                      for i, x in enumerate(_IGNORE_LINES)])
    number = F.regexp_extract("repo", r"^src(\d+)-", 1).cast("int")
    return repos(spark, sf_dir).select("repo", number.alias("k"), F.inline(lines)) \
        .where((F.col("k") % 3 != 0) | (F.col("i") < 4)) \
        .where((F.col("line") != "/") | (F.col("k") % 7 == 4)).select("repo", "line")


SQL_V2 = """
files AS (
  SELECT source||'-'||(doc_id // 1000) AS repo,
         CASE doc_id % 8 WHEN 0 THEN 'node_modules/m' WHEN 1 THEN '.git/objects' WHEN 2 THEN '_pkg'
                         WHEN 3 THEN 'src/build' WHEN 4 THEN 'data/raw' ELSE 'src/api' END
         || '/' || CASE WHEN doc_id % 10 = 7 THEN '.hid' WHEN doc_id % 10 = 6 THEN '__init__' ELSE 'f' END || doc_id
         || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.R' WHEN 3 THEN '.r'
                            WHEN 4 THEN '.log' WHEN 5 THEN '.test.js' ELSE '' END AS rel_path,
         text AS content
  FROM documents
  UNION ALL
  SELECT DISTINCT source||'-'||(doc_id // 1000), '.sandbox/Dockerfile',
         'FROM image:' || (CAST(substr(source,4) AS INT) % 4)
  FROM documents WHERE CAST(substr(source,4) AS INT) % 5 <> 0),
repos AS (SELECT DISTINCT source||'-'||(doc_id // 1000) AS repo FROM documents),
skip AS (SELECT unnest(['__pycache__', 'venv', 'env', 'htmlcov', 'site-packages', 'eggs', 'wheels',
  'node_modules', 'bower_components', 'dist', 'out', 'build', 'coverage', 'vendor', 'bundle', 'target',
  'bin', 'obj', 'Debug', 'Release', 'cmake-build-debug', 'cmake-build-release', 'Carthage', 'Pods',
  'DerivedData', 'tool', 'blib', 'lua_modules', '_build', 'deps', 'dist-newstyle']) AS name),
kept AS (
  SELECT repo, rel_path, content
  FROM (SELECT *, string_split(rel_path, '/')[:-2] AS dirs FROM files),
       (SELECT list(name) AS names FROM skip)
  WHERE NOT list_has_any(dirs, names)
    AND len(list_filter(dirs, lambda d: starts_with(d, '.'))) = 0),
typed AS (
  SELECT *, CASE regexp_extract(rel_path, '/\\.*[^./][^/]*(\\.[^./]*)$', 1)
            WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.R' THEN 'r'
            WHEN '.js' THEN 'javascript' END AS language
  FROM kept),
supported AS (SELECT * FROM typed WHERE language IS NOT NULL),
raw_lines AS (
  SELECT repo, line FROM repos, (VALUES (0, '# note'), (1, 'data/'), (2, '/_pkg'), (3, '*.log'),
    (4, '!keep.log'), (5, '  '), (6, 'data/'), (7, 'api/f?1.*'), (8, '/src/api/.hid*'),
    (9, ' raw '||chr(9)), (10, '_pkg/x'), (11, 'foo['), (12, 'build\\output'), (13, 'bin\\Debug'), (14, '[^b]1'),
    (15, 'f[0-3]*.go'), (16, '[z-a]x'), (17, '/')) v(i, line)
  WHERE (CAST(regexp_extract(repo, '^src(\\d+)-', 1) AS INT) % 3 <> 0 OR i < 4)
    AND (line <> '/' OR CAST(regexp_extract(repo, '^src(\\d+)-', 1) AS INT) % 7 = 4)),
trimmed AS (SELECT repo, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM raw_lines),
rules AS (
  SELECT DISTINCT repo, rtrim(CASE WHEN starts_with(line, '/') THEN '.'||line ELSE line END, '/') AS rule
  FROM trimmed WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '!')
  UNION SELECT repo, name FROM repos, skip),
patterns AS (
  SELECT repo, '/' || CASE rule WHEN 'foo[' THEN 'foo\\[' WHEN 'build\\output' THEN 'buildoutput'
      WHEN 'bin\\Debug' THEN 'binDebug' WHEN '[z-a]x' THEN '[^\\s\\S]x' WHEN '[^b]1' THEN rule
      ELSE replace(replace(regexp_replace(rule, '([.+^$(){}|])', '\\\\\\1', 'g'), '*', '.*'), '?', '.') END || '/' AS re
  FROM rules)
"""


# --- V3: source text with known symbols ----------------------------------------

def _filled(text: str) -> Column:
    """A template's text with the part's names and size."""
    names = {"@n": _key("é_", F.col("base")), "@T": _key("T_", F.col("base")), "@f": _key("f_", F.col("base")),
             "@s": F.col("p_size").cast("string")}
    out = F.col(text)
    for mark, value in names.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text of each part, by the template of its brand and number: (rel_path, p_partkey, language, body)."""
    templates = spark.createDataFrame(BODIES, "b int, shape int, language string, suffix string, template string")
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        key, "p_size", "p_brand", (F.regexp_replace("p_brand", "Brand#", "").cast("int") % len(TEMPLATES)).alias("b"),
        (key % SHAPES).cast("int").alias("shape"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), key.cast("string")).alias("base"))
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "_"), F.lit("/m"),
                    F.floor(key / FILE_SPAN).cast("string"), F.col("suffix"))
    return part.join(F.broadcast(templates), ["b", "shape"]).select(
        path.alias("rel_path"), key, "language", _filled("template").alias("body"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, language, content); a file holds at most FILE_SPAN parts."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))),
                          lambda x: x.body)
    return chunks(spark, sf_dir).groupBy("rel_path", "language").agg(
        F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("content"))


_SQL_FILLED = ("replace(replace(replace(replace({0}, '@n', 'é_' || base), '@T', 'T_' || base), '@f', 'f_' || base), "
               "'@s', CAST(p_size AS VARCHAR))")

SQL_V3 = f"""
templates(b, shape, language, suffix, template) AS (VALUES {sql_values(BODIES)}),
template_definitions(b, shape, tag, name, before, own) AS (VALUES {sql_values(DEFINITIONS)}),
sym AS (
  SELECT p_partkey, p_brand, p_size, replace(p_name, ' ', '_') || '_' || p_partkey AS base,
         CAST(replace(p_brand, 'Brand#', '') AS INT) % {len(TEMPLATES)} AS b, p_partkey % {SHAPES} AS shape FROM part),
chunk AS (
  SELECT *, 'src/' || replace(p_brand, '#', '_') || '/m' || (p_partkey // 1000) || suffix AS rel_path,
         {_SQL_FILLED.format("template")} AS body
  FROM sym JOIN templates USING (b, shape)),
placed AS (
  SELECT *, CAST(coalesce(sum(strlen(body)+2) OVER (PARTITION BY rel_path ORDER BY p_partkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset0 FROM chunk),
expected AS (
  SELECT rel_path, language, tag, {_SQL_FILLED.format("name")} AS symbol_name,
         {_SQL_FILLED.format("own")} AS source_code,
         CAST(offset0 + strlen({_SQL_FILLED.format("before")}) AS BIGINT) AS start_byte
  FROM placed JOIN template_definitions USING (b, shape)),
v3_nodes AS (
  SELECT *, CASE WHEN tag IN ('function', 'macro') THEN 'function' WHEN tag = 'method' THEN 'method' ELSE 'class' END AS node_type,
         sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode(rel_path||':'||start_byte||':'||symbol_name)) AS h
  FROM expected WHERE tag <> 'enum'),
v3_ids AS (
  SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
         substr('89ab', CAST(('0x'||substr(h,17,1))::INT % 4 + 1 AS INT), 1)||substr(h,18,3)||'-'||substr(h,21,12) AS node_id
  FROM v3_nodes)
"""


# --- V4: attempts and telemetry ------------------------------------------------

def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, not yet numbered within its run."""
    ev = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    verdict = (F.when(kind == "purchase", "VULNERABILITY_FOUND")
               .when(kind.isin("signup", "click"), "SYSTEM_SECURE").otherwise("SYNTAX_ERROR"))
    return ev.select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("adversarial").alias("mode"),
        verdict.alias("verdict"), (F.col("user_id") % 4 + 2).cast("int").alias("max_retries"),
        _key("fb ", number).alias("feedback"),
        F.create_map(F.lit("Authorization"), _key("Bearer ", number))
        .alias("extracted_auth_headers"),
        F.create_map(F.lit("sid"), F.when(F.col("event_id") % 4 == 0, "").otherwise(number))
        .alias("extracted_cookies"),
        F.create_map(_key("u", (F.col("event_id") % 3).cast("string")), number)
        .alias("extracted_mock_credentials"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
        .alias("extracted_seeded_entities"),
        F.create_map(F.lit("db"), _key("localhost:", number)).alias("extracted_dynamic_endpoints"),
        F.array(_key("/tmp/", number), F.lit("/tmp/shared")).alias("extracted_ephemeral_files"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id",
        F.when(kind.isin("click", "signup"), 0).when(kind == "error", 1).alias("status_code"),
        (F.col("value") / 7).alias("elapsed"), F.lit(30).alias("timeout_seconds"),
        (kind == "purchase").alias("disconnected"),
        (F.col("event_id") % 17 == 0).alias("api_error"), (F.col("event_id") % 11 == 0).alias("oom"),
        F.when(F.col("event_id") % 5 != 0, _key("out ", F.col("event_id").cast("string"))).alias("stdout"),
        kind.alias("stderr"), _key("lost ", F.col("event_id").cast("string")).alias("error_message"))


SQL_V4 = """
attempts AS (
  SELECT user_id AS run_id, event_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt,
         CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'adversarial' END AS mode,
         CASE event_type WHEN 'purchase' THEN 'VULNERABILITY_FOUND' WHEN 'signup' THEN 'SYSTEM_SECURE'
                         WHEN 'click' THEN 'SYSTEM_SECURE' ELSE 'SYNTAX_ERROR' END AS verdict,
         CAST(2 + user_id % 4 AS INT) AS max_retries, 'fb '||event_id AS feedback,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS sid,
         json_extract_string(props, '$.k') AS k
  FROM events),
judged AS (
  SELECT *, CASE WHEN verdict = 'VULNERABILITY_FOUND' OR (mode = 'baseline' AND verdict = 'SYSTEM_SECURE')
                 THEN 'completed' WHEN attempt >= max_retries THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN attempt >= max_retries THEN 'end'
         WHEN verdict = 'SYNTAX_ERROR' THEN CASE mode WHEN 'baseline' THEN 'baseline_coder' ELSE 'adversary_coder' END
         WHEN verdict = 'VULNERABILITY_FOUND' OR mode = 'baseline' THEN 'end' ELSE 'adversary_coder' END AS next_step
  FROM attempts),
folded AS (
  SELECT run_id, min(attempt) FILTER (next_step = 'end') AS end_attempt,
         coalesce(arg_min(verdict, attempt) FILTER (next_step = 'end'), arg_max(verdict, attempt)) AS verdict,
         coalesce(arg_min(status, attempt) FILTER (next_step = 'end'), 'pending') AS status
  FROM judged GROUP BY run_id),
telemetry AS (
  SELECT user_id AS run_id, event_id,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END AS status_code,
         value / 7 AS elapsed, 30 AS timeout_seconds, event_type = 'purchase' AS disconnected,
         event_id % 17 = 0 AS api_error, event_id % 11 = 0 AS oom,
         CASE WHEN event_id % 5 <> 0 THEN 'out '||event_id END AS stdout, event_type AS stderr,
         'lost '||event_id AS error_message
  FROM events)
"""
