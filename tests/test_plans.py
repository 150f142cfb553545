import pytest

from lodestream.plans.builder import QueryBuilder, tables_in, without_subqueries
from lodestream.plans.graph import HEADER, RelationGraph


@pytest.fixture()
def graph():
    g = RelationGraph()
    g.add_foreign_key("Department", "building_id", "building", "building_id")
    g.add_foreign_key("employee", "department_id", "department", "department_id")
    g.add_foreign_key("project_assignment", "employee_id", "employee", "employee_id")
    g.add_foreign_key("project_assignment", "project_id", "project", "project_id")
    g.add_foreign_key("employee_phone", "employee_id", "employee", "employee_id")
    return g


@pytest.fixture()
def q(graph):
    return QueryBuilder(graph)


def test_graph_names_and_repeats(graph):
    assert graph.has_table("DEPARTMENT") and not graph.has_table("nothing")
    n = len(graph.edges())
    graph.add_foreign_key("EMPLOYEE", "Department_ID", "Department", "department_id")
    assert len(graph.edges()) == n
    assert len(graph.edges("employee")) == 3
    graph.add_foreign_key("employee", "manager_id", "employee", "employee_id")
    assert len(graph.edges("employee")) == 4


def test_paths(graph):
    assert len(graph.join_path(["employee", "building"], "employee")) == 2
    assert len(graph.join_path(["project", "building"], "project")) == 4
    assert graph.join_path(["employee"], "employee") == []
    graph.add_table("island")
    with pytest.raises(ValueError, match="island"):
        graph.join_path(["island"], "employee")


def test_first_of_parallel_keys_and_nearest_table():
    g = RelationGraph()
    g.add_foreign_key("a", "x", "b", "k").add_foreign_key("a", "y", "b", "k")
    assert g.join_path(["b"], "a")[0].from_columns == ("x",)


def test_composite_keys():
    g = RelationGraph()
    g.add_foreign_key("detail", ["a", "b", "c"], "master", ["x", "y", "z"])
    edge = g.edges()[0]
    assert edge.composite and edge.condition("d", "m") == "d.a = m.x AND d.b = m.y AND d.c = m.z"
    for own, far in ((["a"], ["x", "y"]), ([], [])):
        with pytest.raises(ValueError):
            g.add_foreign_key("detail", own, "master", far)
    text = QueryBuilder(g).select("detail.v", "master.w").where("detail.v = ?", 1).build()
    assert "JOIN master ON detail.a = master.x AND detail.b = master.y AND detail.c = master.z" in text


def test_saved_graph(graph, tmp_path):
    path = str(tmp_path / "g")
    graph.save(path)
    again = RelationGraph.load(path)
    assert sorted(again.tables) == sorted(graph.tables) and set(again.edges()) == set(graph.edges())
    for bad in ("", "TABLE x\n", f"{HEADER}\nNONSENSE\n", f"{HEADER}\nFK a b\n"):
        (tmp_path / "g").write_text(bad)
        with pytest.raises(ValueError):
            RelationGraph.load(path)
    (tmp_path / "g").write_text(f"{HEADER}\n\n# a comment\nTABLE employee\n")
    assert RelationGraph.load(path).tables == ["employee"]


def test_plain_select(q):
    text = q.select("employee.first_name", "employee.last_name").where("employee.active = ?", "Y").build()
    assert text == "SELECT employee.first_name, employee.last_name FROM employee WHERE employee.active = ?"
    assert q.parameters == ["Y"]


def test_joins_are_inferred_from_the_filtered_table(q):
    text = q.select("building.address").where("employee.active = ?", "Y").build()
    assert "FROM employee JOIN department ON employee.department_id = department.department_id JOIN building ON department.building_id = building.building_id" in text


def test_kinds_aliases_and_root(q):
    text = q.alias("employee", "e").select("e.first_name", "employee_phone.phone_number").left_join("employee_phone").build()
    assert "FROM employee e LEFT JOIN employee_phone ON employee_phone.employee_id = e.employee_id" in text
    assert q.resolve_alias("E") == "employee"
    root = QueryBuilder(q._graph).select("employee.first_name").left_join("employee").build()
    assert "LEFT" not in root


def test_explicit_and_self_joins(q):
    text = q.select("employee.last_name", "mgr.last_name AS boss").join("employee", "manager_id", "employee", "employee_id", "mgr").build()
    assert text.endswith("FROM employee JOIN employee mgr ON employee.manager_id = mgr.employee_id")
    with pytest.raises(ValueError):
        q.join("a", ["x", "y"], "b", ["z"])


def test_groups(q):
    text = q.select("employee.salary").where("employee.active = ?", 1).start_or().where("employee.level = ?", 2).start_and().where("employee.salary > ?", 3).where("employee.salary < ?", 4).end_and().end_or().build()
    assert text.endswith("WHERE employee.active = ? AND (employee.level = ? OR (employee.salary > ? AND employee.salary < ?))")
    assert q.parameters == [1, 2, 3, 4]
    one = QueryBuilder(q._graph).select("employee.salary").start_or().where("employee.level = ?", 2).end_or().start_or().end_or().build()
    assert one.endswith("WHERE employee.level = ?")
    for end in ("end_or", "end_and"):
        with pytest.raises(ValueError):
            getattr(QueryBuilder(q._graph), end)()
    with pytest.raises(ValueError):
        QueryBuilder(q._graph).select("employee.x").start_or().build()


def test_subqueries_are_not_joined(q, graph):
    inner = QueryBuilder(graph).select("project_assignment.employee_id").where("project_assignment.project_id = ?", 9).order_by("project_assignment.employee_id").limit(3)
    text = q.select("employee.first_name").where_in("employee.employee_id", inner).where_not_exists("SELECT 1 FROM terminated t WHERE t.person_id = ?", 5).build()
    assert "JOIN" not in text and "ORDER" not in text and q.parameters == [9, 5]
    assert tables_in("x.y = (SELECT a.b FROM a WHERE (a.c = 1)) AND d.e = 1") == ["x", "d"]
    assert "select" not in without_subqueries("1 + (select (2)) + (SELECT 3").lower()


def test_aggregates_ctes_unions_and_order_of_parameters(q, graph):
    other = QueryBuilder(graph).select("employee.level").where("employee.salary > ?", 40)
    text = (
        q.with_("dep", "SELECT * FROM department WHERE name = ?", 10)
        .select("employee.level")
        .select_avg("employee.salary", "pay")
        .where("employee.active = ?", 20)
        .group_by("employee.level")
        .having("AVG(employee.salary) > ?", 30)
        .union_all(other)
        .order_by_desc("pay")
        .build()
    )
    assert q.parameters == [10, 20, 30, 40]
    assert text.startswith("WITH dep AS (SELECT * FROM department WHERE name = ?) SELECT employee.level, AVG(employee.salary) AS pay FROM employee")
    assert text.endswith("UNION ALL SELECT employee.level FROM employee WHERE employee.salary > ? ORDER BY pay DESC NULLS FIRST")
    assert "-- Parameters: [10, 20, 30, 40]" in str(q)


def test_errors(q):
    with pytest.raises(ValueError):
        q.build()
    with pytest.raises(ValueError, match="no table"):
        q.select("1").build()
    with pytest.raises(ValueError):
        QueryBuilder(q._graph).parameters  # noqa: B018
    cte = QueryBuilder(q._graph).with_("c", "SELECT 1 AS x").select("c.x").build()
    assert cte.endswith("FROM c")
