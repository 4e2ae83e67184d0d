"""The SQL dialect: translated text, statements, and functions called from SQL."""

import pytest

from tidewater.functions.sql import SqlFunctionError, interval_us
from tidewater.plans.dialect import translate
from tidewater.plans.engine import Engine


@pytest.fixture()
def engine(spark, sf_dir):
    return Engine(spark).load(sf_dir, ["nation", "region", "events"])


def one(engine, text):
    return tuple(engine.sql(text).first())


def test_strings_names_and_comments_are_left_alone():
    text = "SELECT 'a ~ b @@ ''c'' vec_dim(x)' AS t, \"odd name\" FROM n -- x ~ 'y'\nWHERE a = 1"
    assert translate(text) == "SELECT 'a ~ b @@ ''c'' vec_dim(x)' AS t, `odd name` FROM n   WHERE a = 1"


def test_integer_arithmetic(engine):
    assert one(engine, "SELECT CAST(100 AS TINYINT) + CAST(50 AS TINYINT) AS x, 7 / 2 AS q, 7.0 / 2 AS f") == (-106, 3, 3.5)
    assert one(engine, "SELECT sum(n_nationkey / 2) AS s, sum(n_nationkey * 1.0 / 2) AS f FROM nation") == (144, 150.0)


def test_set_comparison_with_nulls_and_empty_sets(engine):
    count = lambda where: one(engine, f"SELECT count(*) FROM nation WHERE {where}")[0]
    assert count("n_regionkey >= ALL (SELECT r_regionkey FROM region)") == 5
    assert count("n_regionkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99)") == 25
    assert count("n_regionkey >= ALL (SELECT nullif(r_regionkey, 0) FROM region)") == 0
    assert count("n_regionkey < ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2)") == 5
    assert count("n_regionkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey = 1)") == 20
    assert count("n_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 1)") == 5


def test_operators(engine):
    assert one(engine, "SELECT 'ABC' ~* 'b', 'ABC' ~ 'b', 'abc' !~ 'x', 'a cat' @@ 'cat', 'concat' @@ 'cat', ~5") == (True, False, True, True, False, -6)


def test_distinct_on_and_ordered_aggregates(engine):
    rows = engine.sql("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey DESC").collect()
    assert sorted(map(tuple, rows)) == [(0, 20), (1, 21), (2, 22), (3, 23), (4, 24)]
    got = one(engine, "SELECT first_value(n_nationkey ORDER BY n_regionkey DESC, n_nationkey) AS f, last_value(n_nationkey ORDER BY n_regionkey) IS NOT NULL AS l, array_agg(r ORDER BY r DESC) AS a, string_agg(concat('', r), '+' ORDER BY r) AS s FROM (SELECT *, n_nationkey % 3 AS r FROM nation WHERE n_nationkey < 3)")
    assert got == (2, True, [2, 1, 0], "0+1+2")


def test_functions_from_sql(engine):
    assert one(engine, "SELECT vec_dim(array(1.0)), vec_dot_product(parse_vec('[1,2]'), parse_vec('[3,4]')), vec_to_string(vec_norm(parse_vec('[3,4]')))") == (1, 11.0, "[0.6,0.8]")
    assert one(engine, "SELECT geohash(57.64911, 10.40744, 11), ipv4_to_cidr('10.1.2.3', 16), ipv4_string_to_num('256.1.1.1'), ipv4_to_cidr('10.1.0.0')") == ("u4pruydqqvj", "10.1.0.0/16", None, "10.1.0.0/16")
    assert one(engine, """SELECT json_path_match('{"a":{"b":2}}', '$.a.b == 2 || $.x > 1'), json_object('k', 1, 'k', 2), json_is_object('[1]')""") == (True, '{"k":2}', False)
    assert one(engine, "SELECT s2_cell_to_token(1152921504606846977), s2_cell_level(1152921504606846977), s2_cell_to_token(s2_cell_parent(1152921504606846977, 10))") == ("1000000000000001", 30, "100001")
    assert interval_us("INTERVAL '1 hour 30 minutes'") == 5_400_000_000
    with pytest.raises(SqlFunctionError):
        engine.sql("SELECT vec_dim()")
    with pytest.raises(SqlFunctionError):
        engine.sql("SELECT date_format(now(), '%Q')")


def test_tables_made_by_statements(engine):
    engine.sql("CREATE TABLE m (host STRING PRIMARY KEY, ts TIMESTAMP(3) TIME INDEX, v DOUBLE)")
    engine.sql("INSERT INTO m VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 1.0), ('a', TIMESTAMP '2024-01-01 00:01:00', 2.0)")
    engine.sql("INSERT INTO m (ts, host, v) VALUES (TIMESTAMP '2024-01-01 00:00:00', 'a', 5.0)")
    assert sorted(r.v for r in engine.sql("SELECT v FROM m").collect()) == [2.0, 5.0]
    assert "TIME INDEX (ts)" in one(engine, "SHOW CREATE TABLE m")[1]
    engine.sql("ALTER TABLE m ADD COLUMN w BIGINT DEFAULT 7")
    assert one(engine, "SELECT sum(w) FROM m")[0] == 14
    with pytest.raises(ValueError):
        engine.sql("ALTER TABLE m DROP COLUMN host")
    engine.sql("CREATE TABLE n LIKE m")
    assert engine.sql("SELECT * FROM n").count() == 0
    assert {r.table_name for r in engine.sql("SELECT table_name FROM information_schema.tables").collect()} >= {"m", "n", "nation"}
    engine.sql("CREATE FLOW f SINK TO sums AS SELECT host, sum(v) AS s FROM m GROUP BY host")
    engine.sql("ADMIN FLUSH_FLOW('f')")
    assert one(engine, "SELECT s FROM sums") == (7.0,)
    assert [r[0] for r in engine.sql("SHOW FLOWS").collect()] == ["f"]
    engine.sql("DROP FLOW f")
    with pytest.raises(ValueError):
        engine.sql("DROP FLOW f")


def test_cursors_settings_and_analyze(engine):
    engine.sql("DECLARE c CURSOR FOR SELECT n_nationkey AS k FROM nation ORDER BY 1")
    assert [r.k for r in engine.sql("FETCH 2 FROM c").collect()] == [0, 1] and [r.k for r in engine.sql("FETCH 1 FROM c").collect()] == [2]
    engine.sql("CLOSE c")
    engine.sql("SET max_rows = 5")
    assert one(engine, "SELECT @@max_rows") == ("5",)
    rows = engine.sql("EXPLAIN ANALYZE SELECT n_regionkey, count(*) FROM nation GROUP BY 1").collect()
    assert any("numOutputRows" in r.metrics for r in rows)
    with pytest.raises(ValueError):
        engine.sql("USE nowhere")


def test_s2_cells(spark):
    """Published cells and points on faces 0, 1, 2, 4 and 5; a point given to nine places is exact to level 20."""
    known = [
        ("47a1cbd595522b39", 49.703498679, 11.770681595), ("52b30b71698e729d", 45.486546517, -93.449700022), ("3663f18a24cbe857", 34.364439040, 108.330699969),
        ("10a06c0a948cf5d", -30.694551352, -30.048758753), ("2b2bfd076787c5df", -25.285264027, 133.823116966), ("94daa3d000000001", -24.694439215, -47.537363213), ("87a1000000000001", 38.899730392, -99.901813021),
        ("b09dff882a7809e1", -75.000000031, 0.000000133),
    ]
    engine = Engine(spark)
    engine.register("places", spark.createDataFrame([(k, a, o) for k, a, o in known], "want string, lat double, lng double"))
    got = engine.sql("SELECT want, s2_cell_to_token(s2_latlng_to_cell(lat, lng)) AS leaf, s2_cell_level(s2_latlng_to_cell(lat, lng)) AS level, s2_latlng_to_cell(91, lng) AS none FROM places").collect()
    for r in got:
        assert r.level == 30 and r.none is None
        assert int(r.leaf.ljust(16, "0"), 16) >> 21 == int(r.want.rjust(16, "0"), 16) >> 21


def test_distinct_values_are_counted_apart_from_sketches(engine):
    rows = [(k, k % 7 if k % 3 else None, k * 0.25, k % 2 if k % 11 else None) for k in range(400)]
    engine.register("odd", engine.spark.createDataFrame(rows, "id int, x int, v double, g int"))
    text = "SELECT g, count(DISTINCT x) AS n, sum(DISTINCT x) * 2 AS s, approx_median(v) AS m, count(*) AS c FROM odd WHERE id < 390 GROUP BY g HAVING count(DISTINCT x) > 2 ORDER BY g"
    assert "tw_d" in translate(text)
    want = []
    for g in (None, 0, 1):
        group = [r for r in rows if r[3] == g and r[0] < 390]
        xs, vs = {r[1] for r in group} - {None}, sorted(r[2] for r in group)
        want.append((g, len(xs), sum(xs) * 2, vs[(len(vs) - 1) // 2], len(group)))
    assert [tuple(r) for r in engine.sql(text).collect()] == want
    assert one(engine, "SELECT count(DISTINCT x) AS n, percentile(v, 0.5) AS m FROM odd WHERE id < 0") == (0, None)
    buffers = engine.sql(text)._jdf.queryExecution().optimizedPlan().toString()
    assert all("approx" not in line or "x#" not in line.split("Aggregate [")[1].split("]")[0] for line in buffers.splitlines() if "Aggregate [" in line)
    for left in ("SELECT count(DISTINCT x), median(v) FROM odd", "SELECT g % 2 AS g, count(DISTINCT x) AS n, median(v) AS m FROM odd GROUP BY g", "SELECT count(DISTINCT x) AS n, sum(v) AS s FROM odd"):
        assert "tw_d" not in translate(left)


def test_intersect_and_except_aggregate_both_sides(engine):
    import duckdb

    rows = {"a": [(1, "x"), (1, "x"), (None, "y"), (None, None), (3, None), (4, "z")], "b": [(1, "x"), (None, "y"), (None, None), (5, "z"), (5, "z")], "c": [(1, "x"), (4, "z"), (7, "q")]}
    base = duckdb.connect()
    for name, values in rows.items():
        engine.register(name, engine.spark.createDataFrame(values, "k int, s string"))
        base.execute(f"CREATE TABLE {name} (k INT, s VARCHAR)")
        base.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    for text in (
        "SELECT k, s FROM a INTERSECT SELECT k, s FROM b", "SELECT k, s FROM a EXCEPT DISTINCT SELECT * FROM b ORDER BY s LIMIT 9", "SELECT k AS n FROM a EXCEPT SELECT CAST(k AS BIGINT) FROM b",
        "SELECT * FROM a UNION ALL SELECT * FROM b INTERSECT SELECT * FROM c", "SELECT * FROM a EXCEPT SELECT * FROM b EXCEPT SELECT * FROM c", "(SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM c)",
        "WITH t AS (SELECT * FROM a INTERSECT SELECT * FROM c) SELECT * FROM t EXCEPT SELECT * FROM b", "SELECT count(*) AS n FROM (SELECT s, k FROM a INTERSECT SELECT s, k FROM b) AS q",
        "SELECT k FROM a INTERSECT ALL SELECT k FROM a EXCEPT SELECT k FROM c", "SELECT k FROM a WHERE k IN (SELECT k FROM b INTERSECT SELECT k FROM c)", "SELECT * FROM c EXCEPT SELECT * FROM a UNION SELECT * FROM b", "SELECT k, k AS j FROM a INTERSECT SELECT k, k FROM b",
    ):
        frame = engine.sql(text)
        order = lambda found: sorted(map(str, map(tuple, found)))
        assert order(frame.collect()) == order(base.execute(text).fetchall()), text
        assert frame.columns == [c[0] for c in base.execute(text).description], text
    plan = engine.sql("SELECT k FROM a INTERSECT SELECT k FROM b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert [r.k for r in engine.sql("SELECT * EXCEPT (s) FROM a WHERE k = 4").collect()] == [4]
