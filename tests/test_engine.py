"""Plans, front ends, predicates, CSV, catalog and runner on small tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import runner
from millrace.operators.predicates import Compare
from millrace.plans import pgplan, sqlfront
from millrace.plans import plan as plan_module
from millrace.plans.plan import Plan
from millrace.plans.verify import golden, phases, same_bag, timed
from millrace.sources.catalog import Catalog, movie_tables
from millrace.sources.tables import as_text, cached_scan, from_rows, read_csv

PAIR = [("a", "INT32"), ("s", "VARCHAR")]
ROWS = [(40, "oak"), (40, "elm"), (None, "yew"), (17, "fir"), (-8, None)]


def joined(spark, left, right, build_left=True):
    plan = Plan()
    a, b = plan.scan(from_rows(spark, left, [("a", "INT32")])), plan.scan(from_rows(spark, right, [("a", "INT32")]))
    plan.join(a, b, [(0, 0)], [0, 1], build_left)
    return sorted(tuple(r) for r in plan.to_dataframe(honour_build=True).collect())


ONE = lambda *xs: [(x,) for x in xs]


def keys(seed, n, kinds, nulls):
    rng = random.Random(seed)
    return [None if rng.random() < nulls else rng.choice(kinds) for _ in range(n)]


WIDE = [-(2**31), -7, 0, 3, 2**31 - 1]


@pytest.mark.parametrize("build_left", [True, False, None])
@pytest.mark.parametrize(("left", "right"), [([], []), ([9], [9]), ([], [4]), (keys(1, 60, WIDE, 0.2), keys(2, 45, WIDE, 0.3)), (keys(3, 300, range(40), 0), keys(4, 200, range(30, 90), 0.1)), (keys(5, 30, [5], 1.0), keys(6, 30, [5], 0.5)), (keys(7, 120, [12], 0), keys(8, 90, [12, 13], 0))])
def test_two_way_joins_equal_nested_loops(spark, left, right, build_left):
    assert joined(spark, ONE(*left), ONE(*right), build_left) == sorted((x, y) for x in left for y in right if x is not None and x == y)


def test_reordered_outputs_and_three_levels(spark):
    plan = Plan()
    a, b = plan.scan(from_rows(spark, ROWS, PAIR), [0]), plan.scan(from_rows(spark, ROWS, PAIR), [1, 0])
    ab = plan.join(a, b, [(0, 1)], [0, 2, 1, 1])
    plan.join(ab, plan.scan(from_rows(spark, [(40, "u" * 9000), (17, None)], PAIR)), [(0, 0)], [2, 5])
    assert sorted(plan.to_dataframe().collect(), key=repr) == sorted([(s, "u" * 9000) for s in ("oak", "oak", "elm", "elm")] + [("fir", None)], key=repr)


def test_scan_root_and_bad_plans(spark):
    plan = Plan()
    a = plan.scan(from_rows(spark, ROWS, PAIR), [1, 1])
    assert plan.to_dataframe().columns == ["c0", "c1"]
    with pytest.raises(ValueError):
        plan.join(a, a, [], [0])
    with pytest.raises(ValueError):
        plan.join(a, a, [(0, 9)], [0])
    plan.join(a, a, [(0, 0)], [0, 3])
    assert plan.to_dataframe().count() == 4


CATALOG = {"t": ["id", "k", "name"], "u": ["id", "k"], "v": ["id", "only"]}


@pytest.mark.parametrize("sql", ["SELECT * FROM t", "SELECT t.id FROM t JOIN u", "SELECT id FROM t, u WHERE t.id = u.id", "SELECT t.id FROM t, u WHERE t.id < u.id", "SELECT t.id FROM t, u", "SELECT t.id FROM t, t WHERE t.id = 1", "SELECT t.zz FROM t", "SELECT t.id FROM w", "SELECT t.id FROM t, u WHERE NOT (t.id = u.id)", "SELECT t.id FROM t WHERE t.id = 1 GROUP BY t.id", "SELECT t.id FROM t WHERE t.id + 1 = 2"])
def test_unsupported_sql(sql):
    with pytest.raises(sqlfront.UnsupportedSql):
        sqlfront.default_tree(sqlfront.parse(sql, CATALOG))


def test_every_class_that_crosses_a_cut_is_a_key():
    b = sqlfront.parse("SELECT only FROM t, u, v WHERE t.id = u.id AND u.id = v.id AND t.k = u.k AND t.id = t.k", CATALOG)
    assert len(b.edges({"t"}, {"u"})) == 2 and b.edges({"t"}, {"v"}) == [(("t", "id"), ("v", "id"))] and len(b.same) == 1
    assert sqlfront.plain_sql("SELECT MIN(t.id) AS from_id FROM t, u WHERE t.id = u.id;", CATALOG) == "SELECT t.id FROM t, u WHERE t.id = u.id"


def test_explain_without_alias_or_hash():
    b = sqlfront.parse("SELECT t.id FROM t, u WHERE t.id = u.id", CATALOG)
    scan = lambda n: {"Node Type": "Seq Scan", "Relation Name": n}
    assert pgplan.join_tree({"Node Type": "Hash Join", "Plans": [scan("t"), {"Node Type": "Hash", "Plans": [scan("u")]}]}, b) == ("t", "u", False)
    with pytest.raises(sqlfront.UnsupportedSql):
        pgplan.join_tree({"Node Type": "Hash Join", "Plans": [scan("t"), scan("u")]}, b)
    with pytest.raises(sqlfront.UnsupportedSql):
        pgplan.join_tree({"Node Type": "Nested Loop", "Plans": [scan("t"), scan("u")]}, b)


def test_not_over_null(spark):
    df = from_rows(spark, [(5, "a"), (None, "b"), (6, None)], PAIR)
    p = ~Compare("a", "=", 5)
    assert df.filter(p.compile(F.col)).count() == 1 and df.filter(p.compile(F.col, True)).count() == 2
    assert (p & Compare("s", "IN", ("a", "it's"))).pretty() == "((NOT (a = 5)) AND (s IN ('a', 'it''s')))"
    x, y, z = Compare("a", ">", 1), Compare("a", "<", 9), Compare("s", "IS NULL")
    assert ((x & y) & z).pretty() == (z & (y & x)).pretty() != ((x | y) & z).pretty()


def test_like(spark):
    df = from_rows(spark, [(1, "a\\b"), (2, "a\nb"), (3, "aéb"), (4, "A_b"), (5, None)], PAIR)
    ids = lambda p: sorted(r.a for r in df.filter(Compare("s", *p).compile(F.col)).collect())
    assert ids(("LIKE", "a\\b")) == [1] and ids(("LIKE", "a_b")) == [1, 2, 3] and ids(("LIKE", "a%")) == [1, 2, 3] and ids(("NOT LIKE", "a%")) == [4]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'1,"q\\"x"\r\n2,""\n,"two\nlines, \\\\ \\k"\n')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv"), PAIR).collect()), key=repr) == sorted([(1, 'q"x'), (2, None), (None, "two\nlines, \\ \\k")], key=repr)
    (tmp_path / "t.csv").write_text("a,s,\n1,x,\n2,,\n")
    assert read_csv(spark, str(tmp_path / "t.csv"), PAIR, Compare("a", ">", 1), header=True, trailing_sep=True).collect() == [(2, None)]
    for bad in ("1,x,y\n", "12abc,x\n", '1,"open\n2,x\n'):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            read_csv(spark, str(tmp_path / "b.csv"), PAIR).collect()


def test_cache_text_and_bags(spark, tmp_path):
    df = from_rows(spark, [*ROWS, (9, 'q"\\')], PAIR)
    kept = cached_scan(df, "t", Compare("a", ">", 1), str(tmp_path))
    assert same_bag(kept, df.filter("a > 1")) and not same_bag(kept, df) and not same_bag(df.union(df), df)
    assert same_bag(cached_scan(df, "t", Compare("a", ">", 1), str(tmp_path)), kept)
    assert {r.line for r in as_text(df).collect()} >= {'40|"oak"', 'NULL|"yew"', "-8|NULL", '9|"q\\"\\\\"'}


def test_two_columns_of_one_class_in_a_table(spark):
    tables = {"t": from_rows(spark, [(1, 1), (2, 9), (9, 9), (3, None)], [("id", "INT32"), ("k", "INT32")]), "u": from_rows(spark, [(1, 0), (2, 0), (9, 0)], [("id", "INT32"), ("k", "INT32")])}
    got = sqlfront.run("SELECT t.id FROM t, u WHERE t.id = u.id AND t.k = u.id", tables, ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 9]
    got = sqlfront.run("SELECT t.id FROM t WHERE NOT (t.id > 1 AND NOT (t.k = 9 OR t.k IS NULL))", tables, ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 9]
    with pytest.raises(sqlfront.UnsupportedSql):
        sqlfront.parse("SELECT t.id FROM t, u WHERE NOT (t.id = u.id AND t.k = 1)", CATALOG)


def test_join_order_goes_by_size(spark):
    tables = {n: spark.range(size).selectExpr("id", "id AS k") for n, size in (("big", 900), ("mid", 300), ("low", 5))}
    b = sqlfront.parse("SELECT big.id FROM big, mid, low WHERE big.id = mid.id AND big.k = low.id", {n: ["id", "k"] for n in tables})
    assert sqlfront.default_tree(b, sqlfront.estimated(b, tables)) == (("low", "big", None), "mid", None)
    assert sqlfront.default_tree(b) == (("big", "mid", None), "low", None)


def test_build_sides_are_hinted_by_size(spark, tmp_path):
    spark.range(200_000).selectExpr("cast(id as int) id", "repeat('x', 200) s").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = Plan()
    a, b = plan.scan(t, [0]), plan.scan(t, [0])
    plan.join(a, b, [(0, 0)], [0], True)
    seen = lambda: plan.to_dataframe(honour_build=True)._jdf.queryExecution().toString()
    assert "shuffle_hash" not in seen().lower()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    assert "shuffle_hash" in seen().lower()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_csv_of_single_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,5" pipe\n2,a"b"c\n3,"x,y"\n')
    for multi in (True, False):
        assert sorted(read_csv(spark, str(tmp_path / "a.csv"), PAIR, multi_line=multi).collect()) == [(1, '5" pipe'), (2, 'a"b"c'), (3, "x,y")]
    (tmp_path / "b.csv").write_text('1,"open\n2,x"\n')
    assert read_csv(spark, str(tmp_path / "b.csv"), PAIR).collect() == [(1, "open\n2,x")]
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "b.csv"), PAIR, multi_line=False)


def test_cache_of_a_source_that_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    from_rows(spark, ROWS, PAIR).write.parquet(path)
    assert cached_scan(spark.read.parquet(path), "t", None, str(tmp_path)).count() == 5
    from_rows(spark, ROWS[:2], PAIR).write.mode("overwrite").parquet(path)
    assert cached_scan(spark.read.parquet(path), "t", None, str(tmp_path)).count() == 2


def test_golden_phases_and_times(spark, tmp_path):
    a, b = from_rows(spark, ROWS, PAIR), from_rows(spark, ROWS, PAIR)
    df = a.join(b, "a")
    assert golden(df, str(tmp_path / "g")) and golden(df, str(tmp_path / "g")) and not golden(df.limit(1), str(tmp_path / "g"))
    got = phases(df.groupBy("a").count())
    assert got["rows"] == 3 and got["total"] > 0 and set(got) > {"rows", "total"}
    assert set(timed(lambda: a, 2)) == {"cold", "median", "mean", "min", "max", "stdev"}


SMALL_DB = {
    "title": [(k, f"title {k}", None, 1 + k % 3, 1990 + k, None, None, None, None, None, None, None) for k in range(30)],
    "movie_keyword": [(k, k % 30, k % 7) for k in range(200)],
    "keyword": [(k, f'word, \\"{k}\\"', None) for k in range(7)],
}


def test_runner_from_text_files_to_checked_rows(spark, tmp_path, capsys):
    known = movie_tables()
    assert len(known) == 21 and sum(map(len, known.values())) == 108 and known["cast_info"][5] == ("nr_order", "INT32")
    data = tmp_path / "db"
    data.mkdir()
    for name, rows in SMALL_DB.items():
        lines = [",".join("" if v is None else f'"{v}"' if isinstance(v, str) else str(v) for v in r) for r in rows]
        (data / f"{name}.csv").write_text("\n".join(lines) + "\n")
    catalog = Catalog(str(data), {n: known[n] for n in SMALL_DB})
    assert catalog.load(spark, "keyword", Compare("id", "<", 2)).collect()[0].keyword == 'word, "0"'
    sql = tmp_path / "sql"
    sql.mkdir()
    (sql / "q1.sql").write_text("SELECT MIN(t.title) AS from_title, MIN(k.keyword) AS w\nFROM title AS t, movie_keyword AS mk, keyword AS k\nWHERE t.id = mk.movie_id AND mk.keyword_id = k.id AND k.id > 3 AND t.production_year BETWEEN 1995 AND 2005;\n")
    (sql / "q2.sql").write_text("SELECT MIN(t.id) AS a FROM title AS t, movie_keyword AS mk WHERE t.id = mk.movie_id AND t.kind_id IN (1, 2);")
    (sql / "q3.sql").write_text("SELECT t.id FROM title AS t ORDER BY t.id;")
    scan = lambda n, a: {"Node Type": "Seq Scan", "Relation Name": n, "Alias": a}
    tree = lambda x, y: {"Node Type": "Hash Join", "Plans": [x, {"Node Type": "Hash", "Plans": [y]}]}
    plans = [{"Plan": {"Node Type": "Aggregate", "Plans": [tree(tree(scan("movie_keyword", "mk"), scan("title", "t")), scan("keyword", "k"))]}}, {"Plan": tree(scan("movie_keyword", "mk"), scan("title", "t"))}, {"Plan": scan("title", "t")}]
    (tmp_path / "plans.json").write_text(json.dumps({"sql_directory": "sql", "names": ["q1", "q2", "q3"], "plans": plans}))
    work = runner.read_workload(str(tmp_path / "plans.json"))
    got = runner.run(spark, catalog, work, ["q1", "q2"], str(tmp_path / "kept"), runs=1)
    assert all(x["correct"] for x in got.values()) and got["q1"]["phases"]["rows"] > 0 and set(got) == {"q1", "q2"}
    assert not runner.run(spark, catalog, work, ["q3"])["q3"]["correct"]
    with pytest.raises(ValueError):
        runner.run(spark, catalog, work, ["q9"])
    # kept rows that are others
    from_rows(spark, [("x", "y")], [("c0", "VARCHAR"), ("c1", "VARCHAR")]).write.mode("overwrite").parquet(str(tmp_path / "kept" / "q1"))
    assert not runner.run(spark, catalog, work, ["q1"], str(tmp_path / "kept"))["q1"]["correct"]
    # the command: Parquet tables, exit code, file of times only when all is right
    small = catalog.to_parquet(spark, str(tmp_path / "pq"))
    assert same_bag(small.load(spark, "title"), catalog.load(spark, "title"))
    for name in known.keys() - SMALL_DB.keys():
        from_rows(spark, [], known[name]).write.parquet(str(tmp_path / "pq" / f"{name}.parquet"))
    args = [str(tmp_path / "plans.json"), str(tmp_path / "pq"), "--kind", "parquet", "--times", str(tmp_path / "times.json")]
    assert runner.main([*args, "q3"]) == 1 and not (tmp_path / "times.json").exists()
    assert runner.main([*args, "q1", "q2"]) == 0 and set(json.loads((tmp_path / "times.json").read_text())) == {"q1", "q2"}
    assert "q1 correct" in capsys.readouterr().out


MULTIPLIED = {
    "class": ("s.id, c.id", "s, c, n WHERE s.k = c.k AND c.k = n.k AND s.k = n.k"),
    "pair": ("s.id, c.id", "s, c WHERE s.k = c.k"),
    "turned": ("s.id, c.id", "c, s WHERE c.k = s.k"),
}


@pytest.mark.parametrize("case", MULTIPLIED)
def test_joins_that_multiply_rows_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch, case):
    """A small file is one task to Spark, however many rows its rows meet."""
    monkeypatch.setattr(plan_module, "MANY_PAIRS", 1000)
    monkeypatch.setattr(plan_module, "TASK_ROWS", 5000)
    tables = {}
    for name, size in {"s": 120, "c": 3000, "n": 6}.items():
        spark.range(size).selectExpr("id", "cast(nullif(id % 6, 4) as int) k").coalesce(1).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    select, rest = MULTIPLIED[case]
    pairs = 5 * 20 * 500
    got = sqlfront.run(f"SELECT {select} FROM {rest}", tables, ["a", "b"])
    tasks = [len(x) for x in got.rdd.glom().collect()]
    assert len(tasks) >= pairs // 5000 and max(tasks) < 2 * pairs / len(tasks)
    assert got.count() == got.distinct().count() == pairs
    assert got.filter("a % 6 <> b % 6 OR a % 6 = 4").isEmpty()


def test_multiplied_rows_are_read_off_arrays_and_none_is_lost(spark, monkeypatch):
    """NULLs besides the key, repeated rows, zeros of both signs and NaN as keys: as Spark's own join has them."""
    monkeypatch.setattr(plan_module, "MANY_PAIRS", 1000)
    monkeypatch.setattr(plan_module, "TASK_ROWS", 5000)
    key = "case id % 4 when 0 then -0.0d when 1 then 0.0d when 2 then double('NaN') end"
    t = {n: spark.range(size).selectExpr("nullif(id % 10, 3) v", f"{key} k", "id div 20 % 2 j") for n, size in (("s", 40), ("c", 400))}
    got = sqlfront.run("SELECT s.v, s.k, c.v, c.k FROM s, c WHERE s.k = c.k AND s.j = c.j", t, ["a", "b", "x", "y"])
    plan = got._jdf.queryExecution().toString()
    assert "Generate posexplode" in plan and "REPARTITION_BY_NUM" in plan
    want = t["s"].toDF("a", "b", "j").join(t["c"].toDF("x", "y", "i"), F.expr("b = y AND i = j")).select("a", "b", "x", "y")
    rows = lambda df: Counter(map(repr, df.collect()))
    assert rows(got) == rows(want) and got.count() == 2 * (10 * 100 + 5 * 50)
    for cols in (["a", "x"], ["x"]):  # one column of the broadcast side, and none
        few = sqlfront.run(f"SELECT {', '.join({'a': 's.v', 'x': 'c.v'}[c] for c in cols)} FROM s, c WHERE s.k = c.k AND s.j = c.j", t, cols)
        assert "Generate explode" in few._jdf.queryExecution().toString() and rows(few) == rows(want.select(*cols))


def test_joins_with_a_unique_key_are_left_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan_module, "MANY_PAIRS", 1000)
    spark.range(3000).selectExpr("id", "id % 120 k").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    got = sqlfront.run("SELECT c.id FROM s, c WHERE s.id = c.k", {"s": t, "c": t}, ["a"])
    assert "REPARTITION_BY_NUM" not in got._jdf.queryExecution().toString()
    assert got.count() == 3000


def test_rows_without_a_key_are_not_counted_as_pairs(spark, monkeypatch):
    """Two sides of which nearly all keys are NULL make few rows, so nothing is dealt out; with keys for a third of the rows it is."""
    monkeypatch.setattr(plan_module, "MANY_PAIRS", 20_000)
    monkeypatch.setattr(plan_module, "TASK_ROWS", 10_000)
    for every, rows in ((1000, 3), (3, 1000 * 100)):
        t = {n: spark.range(size).selectExpr("id", f"if(id % {every} = 0, 7, NULL) k").coalesce(1) for n, size in (("s", 300), ("c", 3000))}
        got = sqlfront.run("SELECT s.id, c.id FROM s, c WHERE s.k = c.k", t, ["a", "b"])
        assert ("REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()) == (rows > 20_000)
        assert got.count() == rows
        assert rows < 20_000 or got.rdd.getNumPartitions() >= rows // 10_000
