"""The engine's queries on the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.predicates import Compare
from millrace.plans import pgplan, sqlfront
from millrace.plans.plan import Plan
from millrace.plans.verify import golden, same_bag
from millrace.sources.catalog import Catalog
from millrace.sources.tables import TABLES, as_text, cached_scan, from_rows, read_csv, read_table

#: Nullable views of driver tables, which hold no NULL themselves: name -> (table, column that is nulled, value).
NULLED = {"orders_n": ("orders", "o_orderstatus", "F"), "customer_n": ("customer", "c_nationkey", 3), "supplier_n": ("supplier", "s_nationkey", 3)}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {t: read_table(spark, sf_dir, t) for t in TABLES}
    for name, (base, col, value) in NULLED.items():
        out[name] = out[base].withColumn(col, F.nullif(F.col(col), F.lit(value).cast(out[base].schema[col].dataType)))
    out["customer_none"] = out["customer"].withColumn("c_nationkey", F.lit(None).cast("int"))
    out["part_bs"] = out["part"].withColumn("p_name", F.concat(F.col("p_name"), F.lit("\\"), F.col("p_brand")))
    return out


_VIEWS = {n: f"(SELECT * REPLACE (nullif({c}, {v!r}) AS {c}) FROM {b})" for n, (b, c, v) in NULLED.items()}
_VIEWS["customer_none"] = "(SELECT * REPLACE (CAST(NULL AS INTEGER) AS c_nationkey) FROM customer)"
_VIEWS["part_bs"] = "(SELECT * REPLACE (p_name || '\\' || p_brand AS p_name) FROM part)"

#: name -> (select list, FROM and WHERE). Every column is returned under its own name, or the one after AS.
SPJ: dict[str, tuple[str, str]] = {
    "scan_project": ("p.p_size, p.p_name, p.p_partkey", "part p"),
    "filter_eq_str": ("r.r_regionkey, r.r_name", "region r WHERE r.r_name = 'ASIA'"),
    "filter_eq_int": ("p.p_partkey, p.p_size", "part p WHERE p.p_size = 15"),
    "filter_neq": ("o.o_orderkey, o.o_orderstatus", "orders o WHERE o.o_orderstatus <> 'F'"),
    "filter_lt": ("p.p_partkey, p.p_size", "part p WHERE p.p_size < 10"),
    "filter_gt": ("o.o_orderkey, o.o_totalprice", "orders o WHERE o.o_totalprice > 250000.5"),
    "filter_le": ("c.c_custkey, c.c_acctbal", "customer c WHERE c.c_acctbal <= 100"),
    "filter_ge": ("c.c_custkey, c.c_acctbal", "customer c WHERE 9000 <= c.c_acctbal"),
    "filter_string_order": ("p.p_partkey, p.p_brand", "part p WHERE p.p_brand BETWEEN 'Brand#1' AND 'Brand#15'"),
    "filter_like_prefix": ("p.p_partkey, p.p_name", "part p WHERE p.p_name LIKE 'blue%'"),
    "filter_like_suffix": ("p.p_partkey, p.p_name", "part p WHERE p.p_name LIKE '%bolt'"),
    "filter_like_infix": ("p.p_partkey, p.p_name", "part p WHERE p.p_name LIKE '%g%'"),
    "filter_like_underscore": ("p.p_partkey, p.p_name", "part p WHERE p.p_name LIKE '_lue%'"),
    "filter_like_backslash": ("p.p_partkey, p.p_name", "part_bs p WHERE p.p_name LIKE '%\\Brand#1_'"),
    "filter_not_like": ("c.c_custkey, c.c_mktsegment", "customer c WHERE c.c_mktsegment NOT LIKE '%U%'"),
    "filter_is_null": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE o.o_orderstatus IS NULL"),
    "filter_is_not_null": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE o.o_orderstatus IS NOT NULL"),
    "filter_between": ("p.p_partkey, p.p_size", "part p WHERE p.p_size BETWEEN 5 AND 9"),
    "filter_in_int": ("p.p_partkey, p.p_size", "part p WHERE p.p_size IN (1, 7, 49)"),
    "filter_in_str": ("o.o_orderkey, o.o_orderpriority", "orders o WHERE o.o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "filter_and_or_nested": ("p.p_partkey, p.p_size, p.p_type", "part p WHERE (p.p_size < 5 AND p.p_type = 'PROMO') OR (p.p_size > 45 AND (p.p_type = 'SMALL' OR p.p_name LIKE 'red%'))"),
    "filter_not_3vl": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE NOT (o.o_orderstatus = 'O')"),
    "filter_not_in_null": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE o.o_orderstatus NOT IN ('O', 'X')"),
    "join_two_way": ("c.c_name, o.o_orderkey", "customer c, orders o WHERE c.c_custkey = o.o_custkey"),
    "join_left_deep": ("r.r_name, n.n_name, c.c_name, o.o_orderkey", "region r, nation n, customer c, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND r.r_name = 'ASIA'"),
    "join_chain4": ("n.n_name, o.o_orderkey, l.l_linenumber", "nation n, customer c, orders o, lineitem l WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_quantity < 5 AND n.n_name IN ('NATION_1', 'NATION_7')"),
    "join_star": ("l.l_orderkey, l.l_linenumber, o.o_orderdate, p.p_name, s.s_name", "lineitem l, orders o, part p, supplier s WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND p.p_size < 20"),
    "join_self": ("n1.n_name AS left_name, n2.n_name AS right_name", "nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey"),
    "join_many_to_many": ("s.s_suppkey, c.c_custkey", "supplier s, customer c WHERE s.s_nationkey = c.c_nationkey"),
    "join_eq_class": ("s.s_suppkey, c.c_custkey, n.n_name", "supplier s, customer c, nation n WHERE s.s_nationkey = c.c_nationkey AND c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey"),
    "join_null_keys": ("s.s_suppkey, c.c_custkey", "supplier_n s, customer_n c WHERE s.s_nationkey = c.c_nationkey"),
    "join_all_null": ("s.s_suppkey, c.c_custkey", "supplier s, customer_none c WHERE s.s_nationkey = c.c_nationkey"),
    "join_empty": ("n.n_name, c.c_custkey", "nation n, customer c WHERE n.n_nationkey = c.c_nationkey AND n.n_name = 'NOWHERE'"),
    "join_tiny_build": ("r.r_name, n.n_name", "region r, nation n WHERE r.r_regionkey = n.n_regionkey"),
    "join_one_side_output": ("c.c_mktsegment", "customer c, orders o WHERE c.c_custkey = o.o_custkey"),
    "join_key_not_output": ("c.c_name, o.o_totalprice", "customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderpriority LIKE '1%'"),
    "join_duplicate_output": ("n.n_name AS first_name, n.n_name AS second_name", "nation n, region r WHERE n.n_regionkey = r.r_regionkey"),
    "join_mixed_width_key": ("s.s_suppkey, n.n_name", "supplier s, nation n WHERE s.s_suppkey = n.n_nationkey"),
    "spj_sql": ("n.n_name, o.o_orderkey", "customer AS c, orders AS o, nation AS n WHERE c.c_custkey = o.o_custkey AND n.n_nationkey = c.c_nationkey AND (o.o_orderstatus = 'P' OR o.o_orderpriority = '5-LOW') AND c.c_acctbal > 0"),
    "join_class_two_columns": ("s.s_suppkey, n.n_nationkey, n.n_regionkey", "supplier s, nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = s.s_nationkey"),
    "filter_not_and": ("p.p_partkey, p.p_size", "part p WHERE NOT (p.p_size > 10 AND p.p_type = 'PROMO')"),
    "filter_not_and_null": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE NOT (o.o_orderstatus = 'O' AND (o.o_totalprice > 1.5e5 OR o.o_orderpriority LIKE '1%'))"),
    "filter_null_literal": ("o.o_orderkey, o.o_orderstatus", "orders_n o WHERE o.o_orderstatus = NULL OR o.o_totalprice < 2e3"),
    "join_or_across": ("c.c_custkey, o.o_orderkey", "customer c, orders o WHERE c.c_custkey = o.o_custkey AND (c.c_acctbal < 0 OR o.o_orderstatus = 'P')"),
}
#: As above, with MIN over each column of the select list.
MINS: dict[str, tuple[str, str]] = {
    "spj_sql_min": ("MIN(n.n_name) AS a, MIN(o.o_totalprice) AS b, MIN(c.c_custkey) AS c", SPJ["spj_sql"][1]),
    "min_empty": ("MIN(n.n_name) AS a, MIN(c.c_custkey) AS b", SPJ["join_empty"][1]),
    "flagship_min": ("MIN(n.n_name) AS n, MIN(c.c_name) AS c, MIN(o.o_orderdate) AS d", "region r, nation n, customer c, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND r.r_name = 'ASIA' AND o.o_orderpriority LIKE '1%'"),
}
_SCAN = lambda t, a: {"Node Type": "Seq Scan", "Relation Name": t, "Alias": a}
_HASH = lambda x: {"Node Type": "Hash", "Plans": [x]}
_JOIN = lambda a, b: {"Node Type": "Hash Join", "Plans": [a, b]}
#: A bushy tree under an aggregate and a gather, as EXPLAIN prints it.
EXPLAINED = {"Plan": {"Node Type": "Aggregate", "Plans": [{"Node Type": "Gather", "Plans": [_JOIN(_JOIN(_SCAN("orders", "o"), _HASH(_SCAN("customer", "c"))), _HASH(_JOIN(_SCAN("nation", "n"), _HASH(_SCAN("region", "r")))))]}]}}
_BUSHY = ("r.r_name, n.n_name, c.c_name, o.o_orderkey", "region r, nation n, customer c, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")


def _names(select: str) -> list[str]:
    return [x.split(" AS ")[-1].strip().split(".")[-1] for x in select.split(",")]


def _spj(name: str, aggregate: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    select, rest = (MINS if aggregate else SPJ)[name]
    return lambda spark, sf_dir: sqlfront.run(f"SELECT {select} FROM {rest};", tables(spark, sf_dir), _names(select), aggregate=aggregate)


def _oracle(select: str, rest: str) -> str:
    used = [f"{n} AS (SELECT * FROM {v})" for n, v in _VIEWS.items() if n in rest]
    return ("WITH " + ", ".join(used) + " " if used else "") + f"SELECT {select} FROM {rest}"


def join_bushy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = (("r", "n", True), ("c", "o", True), True)
    return sqlfront.run(f"SELECT {_BUSHY[0]} FROM {_BUSHY[1]}", tables(spark, sf_dir), _names(_BUSHY[0]), tree)


def join_build_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    plan = Plan()
    o = plan.scan(t["orders"].select("o_orderkey", "o_custkey"), [1, 0])
    c = plan.scan(t["customer"].select("c_custkey", "c_name"))
    plan.join(o, c, [(0, 0)], [1, 3, 0], build_left=False)
    return plan.to_dataframe(["o_orderkey", "c_name", "o_custkey"], honour_build=True)


def plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql, t = f"SELECT {_BUSHY[0]} FROM {_BUSHY[1]};", tables(spark, sf_dir)
    bound = sqlfront.parse(sql, {k: v.columns for k, v in t.items()})
    return sqlfront.run(sql, t, _names(_BUSHY[0]), pgplan.join_tree(EXPLAINED, bound), honour_build=True)


def filter_not_two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlfront.run("SELECT o.o_orderkey, o.o_orderstatus FROM orders_n o WHERE NOT (o.o_orderstatus = 'O')", tables(spark, sf_dir), ["o_orderkey", "o_orderstatus"], two_valued=True)


def join_right_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = ("r", ("n", ("c", "o", True), True), True)
    return sqlfront.run(f"SELECT {_BUSHY[0]} FROM {_BUSHY[1]}", tables(spark, sf_dir), _names(_BUSHY[0]), tree)


def plan_json_no_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql, t = "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", tables(spark, sf_dir)
    scan = lambda x: {"Node Type": "Index Only Scan", "Relation Name": x}
    bound = sqlfront.parse(sql, {k: v.columns for k, v in t.items()})
    return sqlfront.run(sql, t, ["n_name", "r_name"], pgplan.join_tree(_JOIN(scan("nation"), _HASH(scan("region"))), bound))


def executed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten text, with plain columns instead of MIN, run by Spark itself."""
    t = tables(spark, sf_dir)
    text = sqlfront.plain_sql(f"SELECT {MINS['spj_sql_min'][0]} FROM {MINS['spj_sql_min'][1]};", {k: v.columns for k, v in t.items()})
    return sqlfront.any_sql(spark, text, t).toDF("n_name", "o_totalprice", "c_custkey")


def sql_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlfront.any_sql(spark, _SUPERSET, tables(spark, sf_dir))


_SUPERSET = "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least FROM orders WHERE o_totalprice * 2 > 1e5 AND length(o_orderstatus) = 1 GROUP BY o_orderpriority"
#: Texts that are not select-project-join queries, and one that is.
_OTHER = {"group": "SELECT r_name FROM region GROUP BY r_name", "order": "SELECT r_name FROM region ORDER BY r_name", "limit": "SELECT r_name FROM region LIMIT 1", "distinct": "SELECT DISTINCT r_name FROM region", "join": "SELECT r_name FROM region JOIN nation ON r_regionkey = n_regionkey", "plain": "SELECT r_name FROM region"}


def sql_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts the front end turns down."""
    known, out = {"region": ["r_regionkey", "r_name"], "nation": ["n_regionkey"]}, []
    for name, text in _OTHER.items():
        try:
            sqlfront.parse(text, known)
            out.append((name, False))
        except sqlfront.UnsupportedSql:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, rejected boolean")


def rows_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(spark, [(1, "a", 2.5, None), (None, "", None, 7), (-(2**31), None, -0.5, 2**40)], [("a", "INT32"), ("b", "VARCHAR"), ("c", "FP64"), ("d", "INT64")])


def long_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join output of strings of over 8 KB."""
    t = tables(spark, sf_dir)
    t["region"] = t["region"].withColumn("r_name", F.repeat("r_name", 3000))
    return sqlfront.run("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey", t, ["r_name", "n_name"])


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(tables(spark, sf_dir)["orders_n"].select("o_orderkey", "o_orderstatus", "o_orderpriority"))


def bag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)["nation"].select("n_regionkey", "n_name")
    twice = t.union(t)
    cases = {"itself": (t, t), "renamed": (t, t.toDF("x", "y")), "multiplicity": (t, twice), "more": (twice, t), "types": (t, t.withColumn("n_regionkey", F.col("n_regionkey").cast("long")))}
    return spark.createDataFrame([(k, same_bag(a, b)) for k, (a, b) in cases.items()], "name string, equal boolean")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='millrace-')}/{uuid4().hex}"


def _part_csv(spark: SparkSession, sf_dir: str, extra: list[str]) -> str:
    path = _folder(spark)
    cols = [F.col(c) for c, _ in _PART] + [F.lit(None).cast("string").alias(c) for c in extra]
    read_table(spark, sf_dir, "part").select(*cols).write.csv(path, escape="\\")
    return path


_PART = [("p_partkey", "INT64"), ("p_name", "VARCHAR"), ("p_size", "INT32"), ("p_retailprice", "FP64")]


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _part_csv(spark, sf_dir, []), _PART, Compare("p_size", "<=", 25), check_quotes=False, multi_line=False)


def csv_trailing_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _part_csv(spark, sf_dir, ["end"]), _PART, trailing_sep=True)


#: Texts of two columns (a whole number, a text), some of which fail.
_CSV = {"ragged": "1,a,b\n", "short": "1\n", "type": "12abc,x\n", "open": '1,"x\n', "quoted": '1,"a, ""b"\n', "inner": '1,a"b"c\n', "one": '1,5" pipe\n', "plain": "1,a\n"}


def csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts fail to be read."""
    out = []
    for name, text in _CSV.items():
        path = _folder(spark)
        spark.range(1).select(F.lit(text.rstrip("\n"))).write.text(path)
        try:
            read_csv(spark, path, [("a", "INT32"), ("b", "VARCHAR")], escape='"' if name == "quoted" else "\\").collect()
            out.append((name, False))
        except Exception:  # the reader's own errors, whatever their class
            out.append((name, True))
    return spark.createDataFrame(out, "name string, fails boolean")


def csv_inner_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote inside an unquoted field is a character like any other."""
    path = _folder(spark)
    read_table(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", F.concat(F.lit('5" '), "p_name"))).write.text(path)
    return read_csv(spark, path, [("p_partkey", "INT64"), ("p_name", "VARCHAR")])


def table_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole parsed table, read from its cache the second time."""
    folder, read = _folder(spark), read_csv(spark, _part_csv(spark, sf_dir, []), _PART)
    cached_scan(read, "part", None, folder)
    return cached_scan(read, "part", None, folder)


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed tables of a catalog, from CSV files to Parquet files to a join over both views."""
    folder = _folder(spark)
    known = {"nation": [("n_nationkey", "INT32"), ("n_name", "VARCHAR"), ("n_regionkey", "INT32")], "region": [("r_regionkey", "INT32"), ("r_name", "VARCHAR")]}
    for name, columns in known.items():
        read_table(spark, sf_dir, name).select(*[c for c, _ in columns]).write.csv(f"{folder}/{name}.csv", escape="\\")
    found = Catalog(folder, known).to_parquet(spark, f"{folder}/columns").register(spark)
    sql = "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'"
    return sqlfront.run(sql, found, ["n_name", "r_name"])


def golden_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result equals the one kept before: the same, in another order, and a wrong one."""
    path = _folder(spark)
    t = tables(spark, sf_dir)["customer"].select("c_custkey", "c_name")
    golden(t, path)
    cases = {"same": t, "reordered": t.orderBy(F.desc("c_name")), "wrong": t.filter("c_custkey <> 1")}
    return spark.createDataFrame([(k, golden(df, path)) for k, df in cases.items()], "name string, equal boolean")


def scan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, folder = Compare("o_orderpriority", "IN", ("1-URGENT", "2-HIGH")), _folder(spark)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    cached_scan(orders, "orders", where, folder)
    return cached_scan(orders, "orders", where, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _spj(n) for n in SPJ}, **{n: _spj(n, True) for n in MINS},
    "join_bushy": join_bushy, "join_build_right": join_build_right, "plan_json": plan_json,
    "filter_not_two_valued": filter_not_two_valued, "csv_roundtrip": csv_roundtrip, "scan_cache": scan_cache,
    "join_right_deep": join_right_deep, "plan_json_no_alias": plan_json_no_alias, "executed_sql": executed_sql, "sql_superset": sql_superset,
    "sql_rejected": sql_rejected, "rows_to_columns": rows_to_columns, "long_strings": long_strings, "text_sink": text_sink,
    "bag_equality": bag_equality, "csv_trailing_sep": csv_trailing_sep, "csv_errors": csv_errors, "csv_inner_quotes": csv_inner_quotes,
    "table_cache": table_cache, "golden_result": golden_result, "catalog_tables": catalog_tables,
}
ORACLE_SQL: dict[str, str] = {
    **{n: _oracle(*q) for n, q in {**SPJ, **MINS}.items()},
    "join_bushy": _oracle(*_BUSHY), "plan_json": _oracle(*_BUSHY),
    "join_build_right": "SELECT o_orderkey, c_name, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "filter_not_two_valued": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders WHERE o_orderstatus <> 'O'",
    "csv_roundtrip": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size <= 25",
    "scan_cache": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "join_right_deep": _oracle(*_BUSHY),
    "plan_json_no_alias": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "executed_sql": _oracle("n.n_name, o.o_totalprice, c.c_custkey", SPJ["spj_sql"][1]),
    "sql_superset": _SUPERSET,
    "sql_rejected": "SELECT * FROM (VALUES ('group', true), ('order', true), ('limit', true), ('distinct', true), ('join', true), ('plain', false)) AS t(name, rejected)",
    "rows_to_columns": "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a', CAST(2.5 AS DOUBLE), CAST(NULL AS BIGINT)), (NULL, '', NULL, 7), (-2147483648, NULL, -0.5, 1099511627776)) AS t(a, b, c, d)",
    "long_strings": "SELECT repeat(r_name, 3000) AS r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey",
    "text_sink": """SELECT o_orderkey || '|' || CASE WHEN o_orderstatus = 'F' THEN 'NULL' ELSE '"' || o_orderstatus || '"' END || '|"' || o_orderpriority || '"' AS line FROM orders""",
    "bag_equality": "SELECT * FROM (VALUES ('itself', true), ('renamed', true), ('multiplicity', false), ('more', false), ('types', false)) AS t(name, equal)",
    "csv_trailing_sep": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "csv_errors": "SELECT * FROM (VALUES ('ragged', true), ('short', true), ('type', true), ('open', true), ('quoted', false), ('inner', false), ('one', false), ('plain', false)) AS t(name, fails)",
    "csv_inner_quotes": "SELECT p_partkey, '5\" ' || p_name AS p_name FROM part",
    "table_cache": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "catalog_tables": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
    "golden_result": "SELECT * FROM (VALUES ('same', true), ('reordered', true), ('wrong', false)) AS t(name, equal)",
}
