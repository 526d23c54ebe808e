"""SQL fragments shared by the reference queries: text expressions and the model tables derived from the given tables."""

from ..functions.text import LETTERS, LEXICAL_STOPWORDS

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in LEXICAL_STOPWORDS) + "]"


def fold(x: str) -> str:
    return f"lower(translate({x}, 'İI', 'iı'))"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[{LETTERS}]+')"


def lexical_terms(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: length(w) >= 3 AND NOT list_contains({STOP_LIST}, w)))"


def stems(x: str) -> str:
    return (f"list_distinct(list_transform(list_filter({words(x)}, lambda w: length(w) >= 4 AND NOT list_contains({STOP_LIST}, w)), "
            "lambda w: substring(w, 1, 5)))")


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def word_count(x: str) -> str:
    return f"len(list_filter(string_split({squash(x)}, ' '), lambda w: w <> ''))"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]+', '', 'g'))"


def visible(x: str) -> str:
    return f"length(regexp_replace({x}, '[ \\t\\n\\r\\f]+', '', 'g'))"


def ratio4(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN round_even(({a})::DOUBLE / ({b}), 4) END"


PASSAGES = """passages AS (
  SELECT doc_id, source, lang, (pos - 1)::BIGINT AS line_no, line AS text
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(line) <> ''
)"""


SCORED = """scored AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic,
    CASE WHEN quality = 1 AND toxic <> 1 THEN 'APPLIES' WHEN toxic <> 1 THEN 'DOES_NOT_APPLY' ELSE 'UNKNOWN' END AS expected,
    CASE WHEN n_chars >= 2000 THEN 'APPLIES' WHEN n_chars >= 900 THEN 'DOES_NOT_APPLY' WHEN n_chars >= 300 THEN 'UNKNOWN' ELSE 'UNREAD' END AS predicted,
    CASE WHEN lang = 'en' THEN 'HUMAN_REVIEWED' WHEN lang = 'fr' THEN 'MANUAL_LEGAL_READING' END AS row_source,
    CASE WHEN source = 'src3' THEN 'SYNTHETIC_CONTROLLED' END AS field_source
  FROM labels JOIN documents USING (doc_id)
)"""

CALLS = """ev AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, event_type = 'error' AS failed FROM events),
calls AS (
  SELECT event_id AS call_id, ts AS at, 'run_' || (user_id % 5) AS run_id,
    CASE event_type WHEN 'view' THEN 'judge.passage' WHEN 'click' THEN 'judge.scope' ELSE event_type END AS task,
    'model_' || (user_id % 3) AS model, (4096 * (user_id % 2 + 1))::BIGINT AS num_ctx, round(value * 1000)::BIGINT AS elapsed_ms,
    k % 5 = 0 AS cache_hit, k % 3 = 0 AS thinking,
    CASE WHEN failed AND k % 7 = 0 THEN 'CIRCUIT_OPEN' WHEN failed THEN 'FAILED' ELSE 'OK' END AS status,
    CASE WHEN failed AND k % 2 = 0 THEN 'E_' || (k % 4) END AS failure_code,
    CASE WHEN failed AND k % 2 = 0 THEN 'time limit reached' WHEN failed THEN 'bad answer' END AS error,
    k % 4 AS retry_count, k AS prompt_tokens, k % 17 AS output_tokens, k * 10 AS load_duration_ms,
    CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.8 END END::DOUBLE AS gpu_fraction,
    (k % 23)::DOUBLE AS tokens_per_second,
    ['fits', 'compressed', 'fallback_large', 'trimmed'][k % 4 + 1] AS window_action, user_id
  FROM ev
)"""


def f1(p: str, r: str) -> str:
    return (f"CASE WHEN {p} IS NULL OR {r} IS NULL THEN NULL WHEN {p} + {r} = 0 THEN 0.0::DOUBLE "
            f"ELSE round_even(2.0::DOUBLE * {p} * {r} / ({p} + {r}), 4) END")

CAPTURES = """captures AS (
  SELECT o_custkey AS regulation_id, o_orderkey AS capture_id, o_orderdate AS fetched_at,
    sha256(o_orderstatus || substring(o_orderpriority, 1, 1)) AS content_hash,
    'parser-' || CASE WHEN o_orderdate >= TIMESTAMP '1998-06-01' THEN 2 ELSE 1 END AS parser_version FROM orders
)"""


def provisions(name: str, later: bool = False) -> str:
    source = "SELECT *, l_linenumber::BIGINT AS number, l_quantity AS q FROM lineitem"
    if later:
        source = ("SELECT *, unnest(CASE WHEN l_partkey % 11 = 0 THEN [l_linenumber, l_linenumber + 10] ELSE [l_linenumber] END)::BIGINT AS number, "
                  "CASE WHEN l_suppkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_partkey % 10 <> 0")
    return f"""{name} AS (
  SELECT l_orderkey AS version_id, l_returnflag AS section, number,
    CASE l_returnflag
      WHEN 'A' THEN 'A firm must report within ' || floor(q)::BIGINT || ' days of the event, unless exempted under article ' || (l_partkey % 9 + 1) || '.'
      WHEN 'N' THEN 'The rate must not exceed ' || floor(l_discount * 100 + 0.5)::BIGINT || '% of GBP ' || floor(l_extendedprice)::BIGINT || ' where article ' || (l_partkey % 9 + 1) || ' applies.'
      ELSE 'A firm may keep the record for at least ' || floor(q)::BIGINT || ' years in accordance with article ' || (l_partkey % 9 + 1) || '.' END AS text,
    l_partkey, l_suppkey, l_linestatus, q AS l_quantity, l_discount, l_extendedprice, l_shipdate AS dated FROM ({source})
)"""


ENTITIES = """entities AS (
  SELECT c_custkey AS target_id, c_nationkey AS group_id, n_regionkey AS pack_id, [c_mktsegment] AS entity_classes, c_acctbal > 0 AS complete,
    CASE WHEN c_custkey % 7 <> 0 THEN [['PRODUCE', 'IMPORT', 'SELL', 'STORE'][c_custkey % 4 + 1]] END AS activity_classes, c_acctbal > 4000 AS activities_complete
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
scopes AS (
  SELECT r_name || '/' || c_mktsegment AS scope_id, r_regionkey AS pack_id, [c_mktsegment] AS needs_entity,
    CASE r_regionkey % 3 WHEN 0 THEN ['SELL'] WHEN 1 THEN ['IMPORT', 'STORE'] ELSE []::VARCHAR[] END AS needs_activity, r_regionkey = 4 AS unclear, r_regionkey <> 2 AS binding
  FROM region, (SELECT DISTINCT c_mktsegment FROM customer)
),
facts AS (
  SELECT s.scope_id, e.target_id, e.group_id, s.unclear, s.binding, s.needs_activity, e.activity_classes, e.entity_classes, s.needs_entity,
    CASE WHEN list_has_any(entity_classes, needs_entity) THEN true WHEN complete THEN false END AS fe,
    len(needs_activity) > 0 AS ca, CASE WHEN coalesce(list_has_any(activity_classes, needs_activity), false) THEN true WHEN activities_complete THEN false END AS fa
  FROM entities e JOIN scopes s USING (pack_id)
),
decisions AS (
  SELECT *, CASE WHEN unclear THEN 'UNKNOWN' WHEN fe = false OR (ca AND fa = false) THEN 'DOES_NOT_APPLY' WHEN fe IS NULL OR (ca AND fa IS NULL) THEN 'UNKNOWN' ELSE 'APPLIES' END AS status,
    CASE WHEN unclear THEN 'REGULATORY_SCOPE_UNCLEAR'
      WHEN fe = false OR (ca AND fa = false) THEN concat_ws('; ', CASE WHEN fe = false THEN 'ENTITY_MISMATCH' END, CASE WHEN ca AND fa = false THEN 'ACTIVITY_MISMATCH' END)
      WHEN fe IS NULL OR (ca AND fa IS NULL) THEN 'PROFILE_INCOMPLETE'
      ELSE concat_ws('; ', 'ENTITY_MATCH', CASE WHEN ca THEN 'ACTIVITY_MATCH' END) END || CASE WHEN binding THEN '' ELSE '; GUIDANCE_ONLY' END AS reasons
  FROM facts
)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS target_id, p_type AS product_class, string_split(p_name, ' ') AS tags, p_size % 3 <> 0 AS tags_complete,
    CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS size, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price,
    substring(p_brand, 7, 5)::BIGINT % 5 AS pack_id FROM part
),
pscopes AS (
  SELECT p_type || '/' || r_regionkey AS scope_id, r_regionkey::BIGINT AS pack_id, p_type AS needs_class, (r_regionkey * 5 + 5)::DOUBLE AS min_size, 1500.0::DOUBLE AS exempt_price,
    CASE WHEN r_regionkey = 3 THEN ['red', 'blue', 'green'] ELSE []::VARCHAR[] END AS needs_tags
  FROM (SELECT DISTINCT p_type FROM part), region
),
pfacts AS (
  SELECT scope_id, target_id, product_class = needs_class AS fc, size >= min_size AS fs, price > exempt_price AS fx,
    CASE WHEN len(needs_tags) = 0 THEN true WHEN list_has_any(tags, needs_tags) THEN true WHEN tags_complete THEN false END AS ft
  FROM products JOIN pscopes USING (pack_id)
),
pdecisions AS (
  SELECT *, CASE WHEN fc AND fs AND NOT coalesce(fx, false) AND ft THEN 'APPLIES'
    WHEN (fc AND fs AND NOT coalesce(fx, false) AND ft) IS NULL THEN 'UNKNOWN' ELSE 'DOES_NOT_APPLY' END AS status FROM pfacts
)"""

READINGS = """readings AS (
  SELECT l_orderkey AS duty_id, l_partkey AS passage_id, l_linenumber AS number,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 45 THEN 'CONFLICTS' WHEN l_returnflag IN ('A', 'R') AND l_linestatus = 'F' THEN 'SUPPORTS'
      WHEN l_returnflag IN ('A', 'R') THEN 'PARTIAL' WHEN l_linestatus = 'F' THEN 'UNCLEAR' ELSE 'UNRELATED' END AS relation,
    l_suppkey % 5 = 0 AS is_control, 'R' || l_linenumber AS reason, CASE WHEN l_suppkey % 3 = 0 THEN 'strong' ELSE 'weak' END AS uncertainty,
    list_filter([CASE WHEN l_partkey & 1 > 0 THEN 'act_1' END, CASE WHEN l_partkey & 2 > 0 THEN 'deadline_1' END, CASE WHEN l_partkey & 4 > 0 THEN 'item_1' END], lambda x: x IS NOT NULL) AS covered,
    list_filter([CASE WHEN l_partkey & 1 = 0 THEN 'act_1' END, CASE WHEN l_partkey & 2 = 0 THEN 'deadline_1' END, CASE WHEN l_partkey & 4 = 0 THEN 'item_1' END], lambda x: x IS NOT NULL) AS missing,
    l_partkey % 3 = 0 AS number_met, l_suppkey % 2 = 0 AS strong,
    l_partkey % 7 = 0 AND l_returnflag = 'N' AND l_linestatus = 'O' AS rejected, l_partkey % 11 = 0 AS failed, l_suppkey, l_quantity, l_discount, l_extendedprice, l_shipdate
  FROM lineitem
)"""
