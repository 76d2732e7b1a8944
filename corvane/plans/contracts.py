"""Nested contracts and canonical hashes over orders with their lines as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import contracts
from corvane.session import table

SCHEMA = {
    "type": "object", "required": ["key", "lines", "note"], "additionalProperties": False,
    "properties": {
        "key": {"type": "integer", "minimum": 100},
        "status": {"enum": ["F", "O"]},
        "total": {"type": "number", "minimum": 20000},
        "note": {"type": "string", "minLength": 1},
        "lines": {"type": "array", "minItems": 3, "items": {"type": "object", "required": ["flag"], "properties": {"flag": {"type": ["string", "null"], "enum": ["A", "N"]}, "qty": {"type": "integer", "minimum": 5}}, "additionalProperties": False}},
    },
}


def _orders(spark, d):
    """An order as JSON: no note for urgent ones, an extra field for those not specified, an extra one in a fourth line."""
    line = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("qty"), F.when(F.col("l_linenumber") == 4, F.col("l_linenumber")).alias("fourth"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "lines", F.when(F.col("o_orderpriority") != "1-URGENT", "x").alias("note"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 1).alias("extra"))
    return o.select("o_orderkey", F.to_json(doc).alias("doc"))


def contract_nested(spark, d):
    """Violations of every order's document, by its kind."""
    w = contracts.enforce(_orders(spark, d), "doc", SCHEMA, "order", most=1000).select("o_orderkey", "repair_count", F.explode_outer("warnings").alias("w"))
    kind = F.regexp_extract("w", "(enum mismatch|minimum|minItems|missing|additionalProperties|type mismatch|minLength)", 1)
    w = w.select("o_orderkey", "repair_count", kind.alias("kind"))
    return w.groupBy("o_orderkey").agg(F.max("repair_count").cast("long").alias("repairs"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("additionalProperties", "n_additional"), ("enum mismatch", "n_enum"), ("minItems", "n_items"), ("minimum", "n_minimum"), ("missing", "n_missing"))])


def canonical_hashes(spark, d):
    """Customers' hashes by structures whose fields are in different orders, and their tasks' signatures."""
    c = table(spark, d, "customer")
    one = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")).alias("key"), F.array("c_mktsegment").alias("b"))
    two = F.struct(F.array("c_mktsegment").alias("b"), F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")).alias("key"), F.col("c_name").alias("name"))
    return c.select("c_custkey", contracts.canonical_hash(one).alias("one"), contracts.canonical_hash(two).alias("two"), contracts.task_signature(F.array("c_mktsegment", F.lit(" "), "c_mktsegment"), F.array("c_name")).alias("signature"))


QUERIES = {f.__name__: f for f in (contract_nested, canonical_hashes)}
_HASH = """sha256('{"b":["' || c_mktsegment || '"],"key":{"id":' || c_custkey || ',"nation":' || c_nationkey || '},"name":"' || c_name || '"}')"""
ORACLE = {
    "contract_nested": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS flags, count(*) FILTER (WHERE l_quantity::BIGINT < 5) AS qty, count(*) FILTER (WHERE l_linenumber = 4) AS fourth FROM lineitem GROUP BY 1),
        r AS (SELECT o_orderkey, fourth + (o_orderpriority = '4-NOT SPECIFIED')::INT AS n_additional, flags + (o_orderstatus NOT IN ('F', 'O'))::INT AS n_enum, (n < 3)::INT AS n_items, qty + (o_orderkey < 100)::INT + (o_totalprice < 20000)::INT AS n_minimum, (o_orderpriority = '1-URGENT')::INT AS n_missing FROM orders JOIN l ON k = o_orderkey)
        SELECT *, n_additional + n_enum + n_items + n_minimum + n_missing AS repairs FROM r""",
    "canonical_hashes": f"""SELECT c_custkey, {_HASH} AS one, {_HASH} AS two, sha256('{{"hint_tokens":["' || lower(c_name) || '"],"task_tokens":["' || lower(c_mktsegment) || '"]}}') AS signature FROM customer""",
}
