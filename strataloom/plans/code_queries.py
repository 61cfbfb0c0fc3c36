"""Type strings, code tokens, codecs and JSON fields over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import code
from strataloom.functions.tables import KEYWORDS
from strataloom.plans import kb
from strataloom.plans.kb import KB_SQL
from strataloom.plans.tables import read

_TYPES = ("uint", "uint8", "int128", "bytes32", "bytes", "address payable", "bool[3][]", "string", "mapping(address => uint256)", "IERC20", "mapping(bytes32 => mapping(uint => bool))", "function (uint) external")


def type_parts(spark: SparkSession, d: str) -> DataFrame:
    """Types of state variables (a fixed list by part) in parts."""
    t = read(spark, d, "part").select("p_partkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_partkey") % len(_TYPES) + 1).cast("int")), F.when((F.col("p_size") % 4 == 0) & (F.col("p_partkey") % len(_TYPES) < 8), F.lit("[]")).otherwise("")).alias("t"))
    return t.select("p_partkey", code.parse_type(F.col("t")).alias("x")).select("p_partkey", "x.*")


def attached_types(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_partkey") % 3
    body = F.when(kind == 0, F.concat(F.lit("contract$_Token"), F.col("l_suppkey").cast("string"), F.lit("_$"), F.col("l_partkey").cast("string"))).when(kind == 1, F.lit("uint256"))
    t = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("id", F.concat(F.lit("t_function_internal$_t_address_$returns$__$"), F.when(kind < 2, F.concat(F.lit("attached_to$_t_"), body, F.lit("_$"))).otherwise("")))
    return t.select("l_partkey", "l_suppkey", code.attached_type(F.col("id")).alias("attached"))


def code_token_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the tokens of statements made from line items."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("return "), F.lower("l_returnflag"), F.lit("Total += p"), F.col("l_partkey").cast("string"), F.lit(" * 2 >= "), F.col("l_suppkey").cast("string"), F.lit(";")).alias("s"))
    # equal tokens have one class, so it is looked up once for each
    tokens = li.select(F.explode(code.code_words(F.col("s"))).alias("v")).groupBy("v").agg(F.count("*").alias("_n")).select("v", "_n", code.token_class(F.col("v")).alias("class"))
    return tokens.groupBy("class", F.when(F.col("class").isin("operator", "keyword"), F.col("v")).alias("value")).agg(F.sum("_n").alias("n"))


def comment_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Types and statuses from names that are partly unknown, and the first status of a type."""
    e = read(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in (*code.COMMENT_TYPES, "odd")]), (F.col("event_id") % 9 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in (*code.COMMENT_STATUSES, "odd")]), (F.col("user_id") % 9 + 1).cast("int"))
    return e.select("event_id", code.comment_type_of(name).alias("type"), code.comment_status_of(status).alias("status"), code.first_status(name).alias("first"))


def json_array_fields(spark: SparkSession, d: str) -> DataFrame:
    """Ids added to a JSON object as an array field and read back; missing and malformed fields are empty."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("ids"))
    body = F.when(F.col("l_orderkey") % 4 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("l_orderkey").alias("k"))))
    full = code.with_array_field(body, "invariants_to_validate", F.col("ids"))
    rows = li.select("l_orderkey", F.when(F.col("l_orderkey") % 5 == 0, body).when(F.col("l_orderkey") % 7 == 0, F.lit('{"invariants_to_validate":7')).otherwise(full).alias("body"))
    return rows.select("l_orderkey", F.array_join(code.array_field(F.col("body"), "invariants_to_validate"), ",").alias("ids"))


def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    t = kb.topics(spark, d)
    return t.select("topic", F.array_join(code.breadcrumb(F.col("container"), F.col("component"), F.col("member"), F.col("name")), " > ").alias("path"))


QUERIES = {f.__name__: f for f in (type_parts, attached_types, code_token_classes, comment_codecs, json_array_fields, breadcrumbs)}
_LIST = "[" + ", ".join(f"'{x}'" for x in _TYPES) + "]"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in (*xs, "odd")) + "]"
SQL = {
    "type_parts": f"""with t as (select p_partkey, p_partkey % 12 as k, p_size % 4 = 0 and p_partkey % 12 < 8 as more from part)
select p_partkey, ['uint', 'uint', 'int', 'bytes', 'bytes', 'address', 'bool', 'string', 'mapping', 'user', 'mapping', 'function'][k + 1] as base, [256, 8, 128, 32, null, null, null, null, null, null, null, null][k + 1]::int as bits,
  (case when k = 6 then 2 else 0 end + more::int)::int as dims, case k when 8 then 'address' when 10 then 'bytes32' end as key, case k when 8 then 'uint256' when 10 then 'mapping(uint => bool)' end as value from t""",
    "attached_types": "select distinct l_partkey, l_suppkey, case l_partkey % 3 when 0 then 'Token' || l_suppkey when 1 then 'uint256' end as attached from lineitem",
    "code_token_classes": f"""with li as (select l_returnflag, l_partkey, l_suppkey from lineitem), n as (select count(*) as n, sum(length(l_suppkey::varchar))::bigint as digits from li)
select {"'keyword'" if "return" in KEYWORDS else "'identifier'"} as class, {"'return'" if "return" in KEYWORDS else "null"} as value, n from n union all select 'identifier', null, 2 * n from n union all select 'operator', unnest(['+=', '*', '>=', ';']), n from n union all select 'text', null, 8 * n + digits from n""",
    "comment_codecs": f"select event_id, nullif({_list(code.COMMENT_TYPES)}[event_id % 9 + 1], 'odd') as type, case when user_id % 9 = 8 then 'active' else {_list(code.COMMENT_STATUSES)}[user_id % 9 + 1] end as status, case event_id % 9 when 2 then 'unanswered' when 5 then 'unconfirmed' else 'active' end as first from events",
    "json_array_fields": "select l_orderkey, case when l_orderkey % 5 = 0 or l_orderkey % 7 = 0 then '' else string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) end as ids from lineitem group by l_orderkey",
    "breadcrumbs": f"with {KB_SQL} select topic, concat_ws(' > ', container, component, member, name) as path from topics",
}
