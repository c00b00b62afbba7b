import pytest
from pyspark.sql import functions as F

from setwise.operators import shaping as sh

FIELDS = [(20, "color", "red"), (20, "size", "9"), (21, "color", "blue"), (22, None, "lost"), (99, "extra", "no")]


def test_dynamic_pivot(make, rows):
    df = make(FIELDS, "TaskID int, KEY string, Value string")
    out = sh.dynamic_pivot(df, "TaskID", "KEY", "Value", where=F.col("TaskID").between(20, 24), as_text=True)
    assert out.columns == ["TaskID", "color", "size"]
    assert rows(out) == [("20", "red", "9"), ("21", "blue", None)]


def test_dynamic_pivot_count_and_limit(make, rows):
    df = make(FIELDS, "TaskID int, KEY string, Value string")
    assert rows(sh.dynamic_pivot(df, "TaskID", "KEY", "Value", "count").select("TaskID", "color"))[0] == (20, 1)
    with pytest.raises(ValueError):
        sh.dynamic_pivot(df, "TaskID", "KEY", "Value", max_columns=2)


def test_pivot_text_is_whole(make):
    df = make([("a" * 300, "c", "x" * 3000), ("a" * 300 + "b", "c", "y")], "k string, c string, v string")
    got = {r.k: r.c for r in sh.dynamic_pivot(df, "k", "c", "v", as_text=True).collect()}
    assert got == {"a" * 300: "x" * 3000, "a" * 300 + "b": "y"}


def test_pivot_then_unpivot(make, rows):
    df = make([(i % 4, "abc"[i % 3], i) for i in range(40)], "k int, c string, v int")
    wide = sh.dynamic_pivot(df, "k", "c", "v", "sum")
    long = wide.unpivot("k", ["a", "b", "c"], "c", "v").where("v is not null")
    assert rows(long) == rows(df.groupBy("k", "c").agg(F.sum("v")))


def test_split_ordinal(make, rows):
    df = make([(1, " a, b,,c ")], "id int, t string")
    assert rows(sh.split_ordinal(df, "t")) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c")]
    assert len(rows(sh.split_ordinal(df, "t", keep_empty=False))) == 3


def test_xml_nodes(make, rows):
    xml = '<d:Doc xmlns:d="u"><d:Set n="1"><d:Name>x</d:Name></d:Set><d:Set><d:Name>y</d:Name></d:Set></d:Doc>'
    out = sh.xml_nodes(make([(7, xml)], "id int, xml string"), "xml", "Set", {"_n": "int", "Name": "string"}, keep=["id"])
    assert rows(out) == [(7, 1, "x"), (7, None, "y")]


def test_nested_and_append(make, rows):
    df = make([(1, "DB", "X"), (1, "DB", "S"), (1, "DB", "S"), (1, "A", "X")], "e int, g string, m string")
    assert rows(sh.nested_counts(df, "e", "g", "m")) == [
        (1, '[{"group":"A","items":[{"name":"X","count":1}]},{"group":"DB","items":[{"name":"S","count":2},{"name":"X","count":1}]}]')]
    doc = F.struct(F.col("e").alias("id"))
    out = make([(1, "n"), (2, None)], "e int, n string").select(sh.append_fields(doc, {"name": F.col("n")}).alias("d"))
    assert rows(out) == [('{"id":1,"name":"n"}',), ('{"id":2}',)]


def test_select_like(make):
    df = make([(1, 2, 3, 4)], "cpu int, cpu_delta int, reads int, sql_text int")
    assert sh.select_like(df, "[%_delta][cpu%][r%]").columns == ["cpu_delta", "cpu", "reads"]
    assert sh.select_like(df, "[cpu%]", disabled=["cpu_delta"]).columns == ["cpu"]
    for bad in ("[nothing%]", "cpu"):
        with pytest.raises(ValueError):
            sh.select_like(df, bad)


def test_order_like(make):
    df = make([(1, "b"), (1, "a"), (2, "c")], "n int, s string")
    assert [r.s for r in sh.order_like(df, "[n] DESC, [s]").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        sh.order_like(df, "n")


def test_filter_pair(make, rows):
    df = make([(1, "appone"), (2, "apptwo"), (3, None)], "id int, app string")
    fields = {"program": "app", "session": "id"}
    ids = lambda **kw: [r[0] for r in rows(sh.filter_pair(df, fields, **kw).select("id"))]
    assert ids() == [1, 2, 3]
    assert ids(include="APP%", include_by="program") == [1, 2]
    assert ids(exclude="%one", exclude_by="program") == [2, 3]
    assert ids(include="2", include_by="session", exclude="%one", exclude_by="program") == [2]
    with pytest.raises(ValueError):
        ids(include="x", include_by="host")


def test_alignment(make, rows):
    df = make([(1, 1234567), (2, 5)], "id int, n int")
    assert rows(sh.aligned_thousands(df, {"n": 0})) == [(1, "1,234,567"), (2, "        5")]
    elapsed = make([(1, 100 * 86_400_000), (2, 1)], "id int, ms long")
    assert [r[2] for r in rows(sh.aligned_elapsed(elapsed, "ms"))] == ["100 00:00:00.000", "000 00:00:00.001"]


def test_grid(make, rows):
    df = make([(0, 0)] * 9 + [(2, 1)] * 3, "x int, y int")
    assert rows(sh.char_ramp_grid(df, ("x", 0, 2), ("y", 0, 1), " 123456789")) == [(0, "9  "), (1, "  3")]
    assert rows(sh.char_ramp_grid(df.limit(0), ("x", 0, 1), ("y", 0, 0))) == [(0, "  ")]


def test_xml_nodes_at_any_depth(make, rows, plan_of):
    xml = (
        '<p:R xmlns:p="u"><p:S><p:Q p:id="1"><p:B><![CDATA[x xmlns="u" <a:b>]]> &amp; <i>in</i> z</p:B><p:B>second</p:B></p:Q></p:S>'
        '<Q id="2"><B></B><Q id="3"><B>inner</B></Q><N>007</N></Q><Q/><S><Q id="4"><N> 5 </N></Q></S></p:R>')
    texts = [(1, xml), (2, "<broken"), (3, None), (4, ""), (5, "plain"), (6, "<Q><N>1</N></Q>")]
    out = sh.xml_nodes_anywhere(make(texts, "k int, xml string"), "xml", "Q", {"_id": "int", "B": "string", "N": "string"}, ["k"])
    assert rows(out) == sorted([
        (1, 1, 'x xmlns="u" <a:b> & in z', None), (1, 2, None, "007"), (1, 3, "inner", None), (1, None, None, None), (1, 4, None, " 5 "), (6, None, None, "1"),
    ], key=lambda r: [(x is None, x) for x in r])
    assert "Python" not in plan_of(out) and "Arrow" not in plan_of(out)
    with pytest.raises(Exception, match="deep inside each other"):
        sh.xml_nodes_anywhere(make(texts, "k int, xml string"), "xml", "Q", {"_id": "int"}, ["k"], nesting=1).collect()


def test_xml_nodes_by_one_path(make, rows, monkeypatch):
    """Texts whose tags show few nodes side by side are asked once; what the paths a field give is the same."""
    texts = [
        '<R xmlns:p="u"><p:Q p:id="1"><B>a<i>b</i> c</B><N></N></p:Q><Q id=""><!-- <Q/> --><N>2</N></Q></R>',
        "<R><Q id='x'><B> </B></Q><Q>own<N>3</N><B><![CDATA[<Q>]]>&amp;</B></Q><Q ><N>4</N><N>5</N></Q></R>",
        '<R xmlns:p="u" xmlns:q="v"><Q p:id="6" q:id="7"><B>two</B></Q><Qx id="8"/></R>', "<R><Q/><Q id='>'/><Q><Q id='9'/></Q></R>",
        "<R>" + "".join(f"<Q id='{i}'><B>b{i}</B></Q>" for i in range(6)) + "</R>", "<R>" + "".join(f"<Q id='{i}'><B>b{i}</B></Q>" for i in range(11)) + "</R>",
        "<?xml version='1.0'?><Q id='10'><N>1</N></Q>", "<R/>", "<Q id='&lt;Q&gt;'><a:B xmlns:a='u'>z</a:B></Q>", "<Q><B>unclosed</Q>"]
    df = make(list(enumerate(texts)), "k int, xml string")
    fields = {"_id": "string", "B": "string", "N": "string"}
    asked = sh.few_nodes
    monkeypatch.setattr(sh, "few_nodes", lambda *a: (F.lit(None).cast("string"), 0))
    by_field = rows(sh.xml_nodes_anywhere(df, "xml", "Q", fields, ["k"]))
    monkeypatch.setattr(sh, "few_nodes", asked)
    assert rows(sh.xml_nodes_anywhere(df, "xml", "Q", fields, ["k"])) == by_field
    assert len(by_field) == 2 + 3 + 1 + 4 + 6 + 11 + 1 + 1
    monkeypatch.setattr(F, "xpath", lambda xml, path: F.lit(None).cast("array<string>"))
    once = df.where("k IN (1, 4, 7, 8)")
    assert rows(sh.xml_nodes_anywhere(once, "xml", "Q", fields, ["k"])) == [r for r in by_field if r[0] in (1, 4, 7, 8)]


def test_xml_nodes_of_many_attributes(make, rows):
    names = [f"a{i}" for i in range(12)]
    df = make([(1, "<R><Q " + " ".join(f"{n}='{n}'" for n in names) + "/></R>"), (2, "<R><Q a3='x'></Q></R>")], "k int, xml string")
    out = sh.xml_nodes_anywhere(df, "xml", "Q", {f"_{n}": "string" for n in names}, ["k"])
    assert rows(out) == [(1, *names), (2, *[None] * 3, "x", *[None] * 8)]


def test_xml_nodes_keep_cdata(make, rows):
    xml = '<p:D xmlns:p="u"><p:V p:q="7"><p:Value><![CDATA[x xmlns="u" <a:b>]]></p:Value></p:V></p:D>'
    out = sh.xml_nodes(make([(1, xml), (2, "<broken"), (3, None)], "k int, xml string"), "xml", "V", {"_q": "int", "Value": "string"}, ["k"])
    assert rows(out) == [(1, 7, 'x xmlns="u" <a:b>')]
