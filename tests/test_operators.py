"""Operators against hand-made cases: edge cases of columns, readers, stores, builders and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kgloom.functions import columns as C
from kgloom.operators import builder, extract, graph, keywords, metrics, store, topics, transform
from kgloom.operators.graph import Graph
from kgloom.sources import readers
from kgloom.streaming.upsert import merge_stream

NODES = "id string, label string, type string, size double"
EDGES = "src string, dst string, weight double, relationship_type string"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


def small(spark):
    nodes = spark.createDataFrame([("a", "Alpha beta", "concept", 10.0), ("b", "beta", None, 0.0), ("c", "Gamma", "process", 30.0), ("d", "", "concept", None), ("e", "Delta", "concept", 30.0)], NODES)
    edges = spark.createDataFrame([("a", "b", 1.0, "X"), ("a", "b", 2.0, "X"), ("b", "b", 1.0, "X"), ("b", "c", None, "Y"), ("c", "zz", 5.0, "Y")], EDGES)
    return Graph(nodes, edges)


def test_columns(spark):
    assert one(spark, None, C.node_size) == 20 and one(spark, "0", C.node_size) == 20 and one(spark, "150", C.node_size) == 100 and one(spark, "12.5x", C.node_size) == 13
    assert one(spark, "0", C.edge_weight) == 1 and one(spark, "0.01", C.edge_weight) == 0.1 and one(spark, "-3", C.edge_weight) == 0.1
    assert one(spark, "9a b", C.store_key) == "_a_b" and one(spark, "", C.store_key) is None
    assert one(spark, "Foo-Bar  Baz!", C.slug) == "foobar_baz"
    assert one(spark, "foo_bar-baz", C.prettified) == "Foo Bar-Baz"
    assert one(spark, "Gene", C.node_type) == "material" and one(spark, "nothing", C.node_type) == "concept" and one(spark, None, C.node_type) == "concept"
    assert one(spark, "affects", C.relationship_type) == "INFLUENCES" and one(spark, "", C.relationship_type) == "RELATED_TO"
    assert one(spark, "2020abc", lambda x: C.valid_year(x, 2030)) == 2020 and one(spark, "", lambda x: C.valid_year(x, 2030)) is None
    assert one(spark, " a0 ;b, ,c10", C.split_names) == ["a0", "b", "c10"]
    assert one(spark, -2.5, C.round_half_up, "double") == -2
    assert one(spark, "aaaa", lambda x: C.occurrences(x, "aa")) == 2


def test_degrees_and_gaps(spark):
    g = small(spark)
    assert {r["id"]: r["degree"] for r in metrics.degrees(g).collect()} == {"a": 2, "b": 4, "c": 2, "d": 0, "e": 0}
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in metrics.degree_centrality(g).collect()}["b"] == (3, 2)
    assert [r["id"] for r in metrics.hubs(g).collect()] == ["b"]
    assert [r["id"] for r in metrics.isolated_nodes(g).collect()] == ["d", "e"]
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    r = metrics.structure(empty).first()
    assert (r["n_nodes"], r["avg_degree"], r["density"]) == (0, 0.0, 0.0)
    assert metrics.component_modularity(empty).first()["modularity"] == 0.0 and metrics.hubs(empty).count() == 0


def test_components_and_paths(spark):
    g = small(spark)
    assert {r["id"]: r["component"] for r in graph.connected(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0, "X") for i in range(60)], EDGES)
    ids = chain.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert {r["component"] for r in graph.connected(Graph(ids, chain)).collect()} == {"n000"}
    assert graph.shortest_path(chain, "n000", "n003").first()["vertices"] == ["n000", "n001", "n002", "n003"]
    sub = graph.subgraph(g, "a", 1)
    assert sorted(r["id"] for r in sub.nodes.collect()) == ["a", "b"] and sub.edges.count() == 2


def test_view_filter_and_requests(spark):
    v = graph.view_filter(small(spark), 10, 1, 2)
    assert [r["id"] for r in v.nodes.orderBy("id").collect()] == ["c", "e"]
    assert graph.page_of({"page": 3, "per_page": 500}) == (100, 200) and graph.page_of({}) == (50, 0)
    assert graph.sort_of({"sort": "created:DESC"}) == ("created_at", True)


def test_topics(spark):
    p = spark.createDataFrame([(0, "A protein pathway", "gene", "2001"), (1, "", None, "1994"), (2, None, "la plant's leaf", "2025x"), (3, "x", "", "2026")], "paper_ix long, title string, abstract string, pub_year string")
    ok = topics.valid_papers(p)
    assert sorted(r["paper_ix"] for r in ok.collect()) == [0, 2]
    cov = {r["topic"]: r["n"] for r in topics.coverage(ok).collect()}
    assert len(cov) == 8 and cov["Genetics"] == 1 and cov["Plant Science"] == 1 and cov["Molecular Biology"] == 1 and cov["Biophysics"] == 0
    assert {r["paper_ix"]: r["topic"] for r in topics.best_topic(p).collect()} == {0: "Genetics", 1: "Systems Biology", 2: "Plant Science", 3: "Systems Biology"}
    assert sum(r["n"] for r in topics.temporal(ok).where("topic = 'Genetics'").collect()) == 1
    assert topics.extreme_topics(p).first()["most"] == "Systems Biology"


def test_keywords(spark):
    d = spark.createDataFrame([(1, "Big dog, big cat; dog bird 12 a"), (2, None), (3, "")], "doc_id long, text string")
    top = [(r["keyword"], r["n"]) for r in keywords.top_keywords(d, 3).orderBy("doc_id", "rank").collect()]
    assert top == [("big", 2), ("dog", 2), ("cat", 1)]
    w = {r["keyword"]: r["score"] for r in keywords.weighted_keywords(d, ["cat"], 20).collect()}
    assert w["big dog"] == 1.6 and "cat" not in w and math.isclose(w["dog bird"], 0.8)


def test_keywords_of_documents_in_several_rows(spark):
    rows = [(1, "ÉTÉ one\x0btwo2 two2 가나다 one_1"), (2, "the cat sat, the CAT ran"), (1, "six six one 123 K2 \u212am\u0130x"), (None, "nil nil"), (None, "nil"), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    top = keywords.top_keywords(d, 2)
    got = sorted((r["doc_id"] or 0, r["rank"], r["keyword"], r["n"]) for r in top.collect())
    assert got == [(0, 1, "nil", 3), (1, 1, "one", 2), (1, 2, "six", 2), (2, 1, "the", 2), (2, 2, "cat", 2)]
    w = {r["keyword"]: r["score"] for r in keywords.weighted_keywords(d, ["the"], 50).where("doc_id = 1").collect()}
    assert w["가나다"] == 1.0 and w["two2 two2"] == 0.8 and w["one"] == 2.0 and "123" not in w and w["six one"] == 0.8
    assert "HashAggregate" not in top._jdf.queryExecution().executedPlan().toString()  # no table of counts in a task


def test_transform(spark):
    g = small(spark)
    good, bad = transform.validate_nodes(g.nodes)
    assert {r["id"]: r["errors"] for r in bad.collect()} == {"b": ["size_range"], "d": ["label_required"]} and good.count() == 3
    e = spark.createDataFrame([("a", "b", 1.0, "X", 0.5, ["1"]), ("b", "a", 4.0, "Y", 0.9, ["2", "1"])], EDGES + ", confidence double, citations array<string>")
    r = transform.merge_parallel(e).first()
    assert (r["relationship_type"], r["weight"], r["citations"]) == ("Y", 4.0, ["1", "2"])
    assert [r["size"] for r in transform.rescale(g.nodes.where("size > 0"), "size", 20, 50).orderBy("id").collect()] == [20, 50, 50]
    s = transform.stored_edges(g.edges)
    assert transform.client_edges(s).first()["src"] == "a"


def test_store(spark, tmp_path):
    st = store.GraphStore(spark, f"file://{tmp_path}/g", buckets=4)
    g = small(spark)
    one_id = st.create(Graph(g.nodes.where("label <> ''"), g.edges), "t")
    assert st.read("metadata").first()["node_count"] == 4
    new = Graph(spark.createDataFrame([("x", "beta", "concept", 50.0), ("y", "Omega", "concept", 5.0), ("z", "Omega", "concept", 7.0)], NODES), spark.createDataFrame([("a", "b", 2.0, "X"), ("y", "a", 1.0, "Z"), ("y", "a", 3.0, "W")], EDGES))
    st.merge(new, "update")
    sizes = {r["label"]: (r["id"], r["size"], r["graph_id"]) for r in st.read("nodes").collect()}
    assert sizes["beta"] == ("b", 50.0, one_id) and sizes["Omega"] == ("y", 7.0, None)
    assert sorted((r["weight"], r["graph_id"]) for r in st.read("edges").where("src = 'a' and dst = 'b'").collect()) == [(2.0, one_id), (3.0, one_id)]  # the first of two
    assert [(r["weight"], r["relationship_type"]) for r in st.read("edges").where("src = 'y'").collect()] == [(4.0, "W")]
    st.create_edge("a", "b", 0, None)
    assert st.read("edges").where("src = 'a' and dst = 'b'").count() == 3
    st.update_node("b", label="beta two", size=9, nothing=1)
    r = st.read("nodes").where("id = 'b'").collect()
    assert [(x["label"], x["size"]) for x in r] == [("beta two", 9.0)] and r[0]["updated_at"] is not None and st.read("nodes").where("updated_at is null").count() == 4
    st.delete_node("b")
    assert st.read("edges").where("src = 'b' or dst = 'b'").count() == 0 and st.read("edges").count() == 2 and st.read("nodes").count() == 4
    st.export_json(f"{tmp_path}/out")
    assert {r["source"] for r in spark.read.json(f"{tmp_path}/out/edges").collect()} == {"c", "y"}
    second = st.create(g, "other")
    assert st.read("metadata").count() == 2 and st.read("nodes").where(F.col("graph_id") == second).count() == 5
    st.clear()
    assert st.read("nodes").count() == 0 and st.read("edges").columns == st.read("edges", []).columns


def test_store_merge_strategies(spark):
    cols = EDGES + ", note string"
    old = spark.createDataFrame([("a", "b", 1.0, "Y", "p"), ("a", "b", 1.0, "X", "q"), ("c", "d", None, None, "r")], cols)
    new = spark.createDataFrame([("a", "b", 5.0, "Z", 1), ("c", "d", 2.0, "Z", 2), ("e", "f", 2.0, "Y", 3), ("e", "f", 4.0, "X", 4)], EDGES + ", k int")
    rows = lambda df: sorted((r["src"], r["relationship_type"] or "", r["weight"], r["note"] if "note" in df.columns else None) for r in df.collect())
    assert rows(store.merge_edges(old, new, "update")) == [("a", "X", 6.0, "q"), ("a", "Y", 1.0, "p"), ("c", "", 2.0, "r"), ("e", "X", 6.0, None)]
    assert [r for r in rows(store.merge_edges(old.na.fill(0), new, "append")) if r[0] == "e"] == [("e", "X", 4.0, None)]
    assert rows(store.merge_edges(old, new, "replace")) == [("a", "Z", 5.0, None), ("c", "Z", 2.0, None), ("e", "X", 4.0, None)]


def test_store_crash(spark, tmp_path, monkeypatch):
    """A change whose writer dies before it publishes leaves nothing; the same batch again has its effect once."""
    st = store.GraphStore(spark, f"file://{tmp_path}/g")
    g = Graph(spark.createDataFrame([("a", "A", "concept", 1.0)], NODES), spark.createDataFrame([("a", "a", 1.0, "X")], EDGES))
    st.merge(g, "update", 0)
    publish = store.GraphStore._publish

    def dies(self, state):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.GraphStore, "_publish", dies)
    with pytest.raises(RuntimeError):
        st.merge(g, "update", 1)
    monkeypatch.setattr(store.GraphStore, "_publish", publish)
    assert st.read("edges").first()["weight"] == 1.0
    for _ in range(2):
        st.merge(g, "update", 1)
        assert st.read("edges").first()["weight"] == 2.0 and st.manifest()["batch"] == 1
    assert st.ensure("edges", "x int") and not st.ensure("other", "x int") and st.ensure("other", "x int")


def test_store_records(spark, tmp_path):
    st = store.GraphStore(spark, f"file://{tmp_path}/g")
    st.set_status("u1", "processing", filename="f.csv")
    st.set_status("u2", "processing")
    st.set_status("u1", "completed", graph_id="g")
    assert sorted((r["upload_id"], r["status"], r["filename"], r["graph_id"]) for r in st.read("uploads").collect()) == [("u1", "completed", "f.csv", "g"), ("u2", "processing", None, None)]
    assert st.save_analysis("abc", "network", "g", {"k": 1}, {"n": [1]}) and not st.save_analysis("abc", "other", None, {}, {}) and st.save_analysis("xbc", "peo", None, {}, {}, 1.5)
    assert {r["analysis_id"] for r in st.analyses("bc").collect()} == {"abc", "xbc"} and json.loads(st.analyses("ab").first()["results"]) == {"n": [1]}


def test_attribute_merge(spark):
    old = spark.createDataFrame([("a", "L", "c", 1.0, {"k": "1", "q": "0"})], NODES + ", attributes map<string,string>")
    new = spark.createDataFrame([("b", "L", "c", 2.0, {"k": "2"})], NODES + ", attributes map<string,string>")
    assert store.merge_nodes(old, new, "update").first()["attributes"] == {"k": "2", "q": "0"}
    assert store.merge_nodes(old, new, "append").count() == 1 and store.merge_nodes(old, new, "replace").first()["id"] == "b"


def test_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", "b", 1.0, "X")], EDGES).write.mode("append").parquet(src)
    st = store.GraphStore(spark, f"file://{tmp_path}/g")
    nodes_of = lambda e: e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit("concept").alias("type"), F.lit(20.0).alias("size"))
    for n in (1, 2):
        stream = spark.readStream.schema(EDGES).parquet(src)
        merge_stream(nodes_of, stream, st, f"{tmp_path}/cp").awaitTermination()
        assert st.read("edges").agg(F.sum("weight")).first()[0] == float(n)
        spark.createDataFrame([("a", "b", 1.0, "X")], EDGES).write.mode("append").parquet(src)


def test_readers(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('Paper Title,Abstract,Year\n"A, B",x,2001\n\nshort,"say ""hi""",1999,extra\n')
    rows = readers.read_csv(spark, str(p))
    assert rows.columns == ["paper_title", "abstract", "year"] and {r["paper_title"] for r in rows.collect()} >= {"A, B"}
    papers, status = readers.read_many(spark, [str(p), str(tmp_path / "none.csv")])
    assert sorted(r["status"] for r in status.collect()) == ["completed", "failed"] and papers.count() >= 1
    assert one(spark, 'a,"b, c",d', readers.parse_csv_line) == ["a", "b, c", "d"]
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"nodes": [{"id": "x", "label": "X", "size": 99}, {"name": "Y"}], "edges": [{"from": "x", "to": "node_1", "value": 0}]}))
    kg = readers.read_graph_json(spark, str(g))
    assert [(r["id"], r["label"], r["size"]) for r in kg.nodes.orderBy("pos").collect()] == [("x", "X", 50.0), ("node_1", "Y", 20.0)]
    assert kg.edges.first()["weight"] == 1.0 and kg.edges.first()["relationship_type"] == "RELATED_TO"
    assert one(spark, "a.b.XLSX", readers.file_kind) == "excel" and one(spark, None, readers.file_kind) == "unknown"
    assert readers.header_mapping(["Paper Title", "DOI", "Pub Year"]) == {"title": "Paper Title", "doi": "DOI", "year": "Pub Year"}
    b = tmp_path / "f.pdf"
    b.write_bytes(b"caf\xe9\x00 text " * 20)
    assert "text" in readers.read_file_texts(spark, str(b)).first()["text"]


def test_sampling_and_chunks(spark):
    df = spark.createDataFrame([("x" * 9,)] * 50 + [(f"row {i:04d}",) for i in range(100)], "value string")
    got = readers.char_budget_sample(df, 200)
    assert 0 < got.agg(F.sum(F.char_length("value") + 1)).first()[0] <= 200 and readers.char_budget_sample(df, 10**6).count() == 150
    c = readers.chunks(spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string"), size=4, overlap=1)
    assert [r["text"] for r in c.orderBy("chunk").collect()] == ["abcd", "defg", "ghij", "j"]


def test_extraction(spark):
    text = "References are [1] and (2). Chlorophyll is a green pigment that drives photosynthesis in plants and it absorbs light energy every day [3]. The chlorophyll rate was 25.3 mg/L today. Photosynthesis causes chlorophyll growth in leaves"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "doc_id long, page_num int, text string")
    c = extract.node_candidates(pages)
    got = {r["label"]: r for r in c.collect()}
    assert got["Chlorophyll"]["definition"].startswith("a green pigment") and got["Chlorophyll"]["importance"] == 5
    g = extract.extract_graph(pages)
    assert {"Chlorophyll", "Photosynthesis"} <= {r["label"] for r in g.nodes.collect()}
    e = extract.sentence_edges(pages, spark.createDataFrame([(1, "Chlorophyll"), (1, "Photosynthesis")], "doc_id long, label string")).collect()
    assert len(e) == 1 and {e[0]["src"], e[0]["dst"]} == {"Chlorophyll", "Photosynthesis"}
    assert one(spark, "see [1, 2] and Smith et al. (2000)", extract.citations)[:1] == ["[1, 2]"]
    refs = extract.references_of(spark.createDataFrame([(1, "x\nReferences\n 1. Smith J, Doe A. 'A title' Nature 12 2001 doi: 10.1/ab\n2. Roe B. Other thing. Cell 3 2010")], "doc_id long, text string")).collect()
    assert [r["year"] for r in refs] == ["2001", "2010"] and refs[0]["doi"] == "10.1/ab"
    assert extract.extract_with(pages.select("doc_id", "text"), lambda t: [{"source": "a", "target": "b"}] if t else []).count() == 1


def test_embedding(spark):
    v = one(spark, "alpha beta", lambda x: extract.hash_embedding(x, 16))
    assert math.isclose(sum(x * x for x in v), 1.0)

    def h(w):
        x = 0
        for ch in w:
            x = (x * 31 + ord(ch)) & 0xFFFFFFFF
        return abs(x - (1 << 32) if x >> 31 else x)

    raw = [sum(math.sin((h(w) + i) * 0.01) / (k + 1) for k, w in enumerate(["alpha", "beta"])) for i in range(16)]
    n = math.sqrt(sum(x * x for x in raw))
    assert all(math.isclose(a, b / n, abs_tol=1e-9) for a, b in zip(v, raw))


def test_builder(spark):
    raw = spark.createDataFrame([(0, None, "Green leaf", None, 0.0, None), (1, "n1", None, "Leaf area", 5.0, "process"), (2, "n2", "Leaf area", None, 7.0, None), (3, None, None, None, 1.0, None)], "pos int, id string, label string, name string, size double, type string")
    links = spark.createDataFrame([(0, "green-leaf", "n1", "", None), (1, "n1", "Green leaf", "x", 2.0), (2, "n1", "n1", "x", 2.0), (3, "new_thing", "n2", None, 0.0)], "pos int, src string, dst string, label string, weight double")
    g = builder.build(raw, links)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert len(nodes) == 4 and {"green_leaf", "n1", "n2"} <= set(nodes)
    assert nodes["green_leaf"]["size"] == 30
    ids = g.nodes.select("id").distinct()
    assert graph.connected(Graph(ids, g.edges)).select("component").distinct().count() == 1


@pytest.mark.parametrize("many", [8, 2, 0])
def test_bridge(spark, many):
    """The most alike pair of labels of each component, by all pairs."""
    import random

    rng = random.Random(many)
    rows = [(f"n{i:02d}", " ".join(rng.sample("red green blue dark light cold".split(), rng.randrange(4)))) for i in range(40)]
    comp = {i: "n00" if int(i[1:]) < 22 else f"n{int(i[1:]) // 2 * 2:02d}" for i, _ in rows}
    e = [(comp[i], i, "x", 1.0, 0) for i, _ in rows if comp[i] != i]
    nodes, edges = spark.createDataFrame(rows, "id string, label string"), spark.createDataFrame(e, "src string, dst string, label string, weight double, pos int")
    got = {(r["src"], r["dst"], r["weight"]) for r in builder.bridge(nodes, edges, many).where("label = 'contextual_link'").collect()}
    want = set()
    for c in {*comp.values()} - {"n00"}:
        pairs = []
        for i, x in rows:
            for j, y in rows:
                x_, y_ = set(x.split()), set(y.split())
                if comp[i] == c and comp[j] == "n00" and x_ & y_:
                    pairs.append((-len(x_ & y_) / len(x_ | y_), i, j))
        s, i, j = min(pairs, default=(-0.3, c, "n00"))
        want.add((i, j, float(max(2, math.floor(-s * 10 + 0.5)))))
    assert got == want


def test_answers(spark):
    text = """Here is it:
    ```json
    {"Nodes_list": [{"Node ID": "a", "labelName": "Alpha", "SIZE": "12"}, {"label": "Beta thing", "extra": 1}], "Relationships": [{"Source": "a", "target_node": "Beta thing", "weight": 0}], "note": "x"}
    ```"""
    df = spark.createDataFrame([(1, text), (2, "no braces"), (3, "{broken"), (4, None)], "doc_id long, text string")
    objects = builder.entries_of(df, "nodes")
    rows = [(r["doc_id"], r["id"], r["label"], r["size"]) for r in builder.repaired(objects, ["id", "label", "size"]).orderBy("pos").collect()]
    assert rows == [(1, "a", "Alpha", "12"), (1, None, "Beta thing", None)]
    g = builder.graph_of_answers(df)
    assert {r["id"] for r in g.nodes.collect()} == {"a", "beta_thing"} and [(r["src"], r["dst"], r["weight"]) for r in g.edges.collect()] == [("a", "beta_thing", 3.0)]


def test_csv_run(spark, tmp_path):
    assert keywords.csv_options('{"max_keywords": 3, "minFrequency": 0, "include_authors": false}') == {"maxKeywords": 3, "minFrequency": 2, "includeAuthors": False, "includeJournals": True}
    assert keywords.csv_options("nonsense")["maxKeywords"] == 10
    p = tmp_path / "in" / "p.csv"
    p.parent.mkdir()
    p.write_text("Title,Abstract,Keywords\nred fox,fox runs,alpha; beta\nred owl,owl runs,beta\n")
    (tmp_path / "in" / "g.json").write_text(json.dumps({"nodes": [{"id": "x"}, {"id": "y"}], "edges": [{"source": "x", "target": "y"}]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    (tmp_path / "in" / "other.txt").write_text("x")
    g, meta = keywords.csv_graph(readers.papers_of(readers.read_csv(spark, str(p))), "p.csv", {"max_keywords": 5})
    assert {"keyword_red", "keyword_runs", "keyword_beta"} == {r["id"] for r in g.nodes.collect()} and meta.first()["source_papers"] == 2
    with pytest.raises(ValueError):
        keywords.csv_graph(readers.papers_of(readers.read_csv(spark, str(p))).limit(0), "e")
    st = store.GraphStore(spark, f"file://{tmp_path}/g")
    dry = {r["path"].rpartition("/")[2]: (r["status"], r["nodes"]) for r in readers.migrate_folder(spark, f"{tmp_path}/in", st, dry_run=True).collect()}
    assert dry["g.json"] == ("read", 2) and dry["p.csv"] == ("read", 4) and set(dry) == {"g.json", "p.csv", "bad.json"} and st.read("nodes") is None
    done = readers.migrate_folder(spark, f"{tmp_path}/in", st, "json")
    assert {r["status"] for r in done.where("path like '%g.json'").collect()} == {"stored"} and st.read("nodes").count() >= 2


def test_paths_and_measures(spark):
    e = spark.createDataFrame([("a", "b", 5.0, "X"), ("a", "c", 1.0, "X"), ("b", "d", 1.0, "Y"), ("c", "d", 9.0, "Y"), ("d", "e", None, "Z"), ("d", "e", 4.0, "W"), ("a", "a", 1.0, "L")], EDGES)
    want = graph.paths(e, "a", "e", 5).orderBy("length", "total_weight", "vertices").first()
    got = graph.shortest_path(e, "a", "e").first()
    assert (got["vertices"], got["types"], got["length"], got["total_weight"]) == (want["vertices"], want["types"], want["length"], want["total_weight"]) == (["a", "b", "d", "e"], ["X", "Y", "Z"], 3, 7.0)
    assert graph.shortest_path(e, "a", "nowhere").count() == 0 and graph.shortest_path(e, "a", "e", 2).count() == 0
    g = Graph(spark.createDataFrame([(i, i, "concept", 1.0) for i in "abcde"], NODES), e)
    c = metrics.centrality(g, ("degree", "closeness", "nothing"))
    assert set(c) == {"degree", "closeness"} and {r["id"]: r["degree"] for r in c["degree"].collect()}["d"] == 4
    member = spark.createDataFrame([(f"x{i}", "p") for i in range(20)] + [(f"y{i}", "q") for i in range(20)], "id string, cluster string")
    weak = metrics.structural_gaps(Graph(member.select("id"), spark.createDataFrame([("x1", "y1", 1.0, "X")], EDGES)), member).collect()
    assert [(r["kind"], r["a"], r["b"], r["connections"]) for r in weak] == [("weak", "p", "q", 1)]


def test_numbered(spark):
    from kgloom.operators.iterate import numbered

    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = {r["id"]: r["p"] for r in numbered(df, ["x", "id"], "p").collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: (i % 7, i)))} and numbered(df.limit(0), ["id"], "p").count() == 0


def test_resolve_clusters_and_scores(spark):
    n = small(spark).nodes
    c = spark.createDataFrame([("one", " BETA"), ("two", "none")], "cluster string, label string")
    assert {(r["cluster"], r["id"]) for r in graph.resolve_clusters(n, c).collect()} == {("one", "b"), ("misc_cluster", "a"), ("misc_cluster", "c"), ("misc_cluster", "d"), ("misc_cluster", "e")}
    gold, found = spark.createDataFrame([(1, "A-b"), (1, "c")], "doc_id int, label string"), spark.createDataFrame([(1, "ab"), (1, "x")], "doc_id int, label string")
    r = builder.score_labels(gold, found).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)


def test_store_buckets(spark, tmp_path):
    """The number of buckets is the store's, whoever opens it; small files are joined; nodes without a label merge."""
    nodes = spark.createDataFrame([(f"n{i}", f"L{i}", "concept", 10.0) for i in range(20)] + [("none", None, "concept", 10.0)], NODES)
    edges = spark.createDataFrame([("n0", "n1", 1.0, "X")], EDGES)
    root = f"file://{tmp_path}/g"
    store.GraphStore(spark, root, buckets=16).merge(Graph(nodes, edges))
    again = store.GraphStore(spark, root, buckets=3)
    assert again.buckets == 16
    for strategy in ("append", "update"):
        again.merge(Graph(nodes, edges), strategy)
        assert again.read("nodes").count() == 21 and again.read("edges").count() == 1
    for _ in range(3):
        again.create_edge("a", "b")
    before = {(r["src"], r["dst"], r["weight"], r["relationship_type"]) for r in again.read("edges").collect()}
    again.rewrite("edges")
    assert again.read("edges").count() == 4 and {(r["src"], r["dst"], r["weight"], r["relationship_type"]) for r in again.read("edges").collect()} == before
    assert len(list((tmp_path / "g" / "data" / "edges").iterdir())) == 1 and again.read("nodes").count() == 21


def test_csv_upload(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,year\nfox,2001\nowl,2002\n")
    (tmp_path / "b.csv").write_text("title,doi\ncat,10.1/x\n")
    (tmp_path / "empty.csv").write_text("title,year\n")
    st = store.GraphStore(spark, f"file://{tmp_path}/g")
    assert st.upload_csv(f"{tmp_path}/a.csv") == 2 and st.upload_csv(f"{tmp_path}/b.csv") == 1
    with pytest.raises(ValueError):
        st.upload_csv(f"{tmp_path}/empty.csv")
    assert {(r["title"], r["year"], r["doi"]) for r in st.read("metadata_collection").collect()} == {("fox", "2001", None), ("owl", "2002", None), ("cat", None, "10.1/x")}


def test_csv_rows(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("'Paper' \"Title\",Abs,Year\n\"A, B\",x,2001\n\nshort,row\nO'Neil,\" y \",1999,extra\n,,\n\"q, r\",only\n")
    df = readers.read_csv(spark, str(p))
    assert df.columns == ["paper_title", "abs", "year"]
    assert sorted(tuple(r) for r in df.collect()) == [("", "", ""), ("A, B", "x", "2001"), ("ONeil", "y", "1999")]


def test_parallel_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "X"), ("a", "b", 1.0, "X"), ("b", "c", 2.0, "Y")], EDGES)
    assert [(r["vertices"], r["total_weight"]) for r in graph.paths(e, "a", "a", 2).collect()] == [(["a", "b", "a"], 2.0)] * 2
    assert graph.paths(e, "a", "c", 4).count() == 2


def test_budget_rows(spark):
    df = spark.createDataFrame([("",)] * 30 + [("x",)] * 30, "value string")
    assert readers.char_budget_sample(df, 20).agg(F.sum(F.char_length("value") + 1)).first()[0] <= 20


def test_malformed_links(spark):
    def links(*objects):
        answers = spark.createDataFrame([(json.dumps({"links": list(objects)}),)], "text string")
        return [(r["src"], r["dst"], r["label"], r["weight"], r["auto"]) for r in builder.links_of(builder.entries_of(answers, "links")).orderBy("pos", "k").collect()]

    assert links({"Source Id": " a ", "TARGET": "b", "weight": "5", "Label": "x"}) == [("a", "b", "x", 5.0, False)]
    assert links({"source": "a", "target": "b"}) == [("a", "b", "related_to", 3.0, False)]
    assert links({"a": "b"}) == [("a", "b", "related_to", 3.0, True)]
    assert links({"a": ["b", "", None, "c", {"label": "d"}, 7]}) == [("a", x, "related_to", 3.0, True) for x in ("b", "c", "d", "7")]
    assert links({"a": None, "regulates": ["b", "c"]}) == [("a", "b", "regulates", 3.0, True), ("a", "c", "regulates", 3.0, True)]
    assert links({"source": "a", "Drives": "b", "description": "why"}) == [("a", "b", "drives", 3.0, True)]
    assert links({"a": "", "limits": "", "b": "c"}) == [("b", "c", "limits", 3.0, True)]
    assert links({"a": "b", "regulates": "c", "d": {"id": "e", "x": 1}}) == [("a", "b", "related_to", 3.0, True), ("a", "c", "regulates", 3.0, True), ("d", "e", "related_to", 3.0, True)]
    assert links({"regulates": "b"}, {}, {"source": "a"}, {"target": "b", "weight": 1}) == []
    assert links({"a": "[broken", "": "c"}) == [("a", "[broken", "related_to", 3.0, True), ("a", "c", "related_to", 3.0, True)]


def test_graph_of_malformed_answers(spark):
    answer = {"nodes": [{"id": "a", "label": "Alpha", "traits": ["t"], "frequency": 40}, {"label": "Beta"}], "links": [{"Alpha": "Gamma", "drives": ["Beta"]}, {"source": "a", "target": "beta", "label": "late"}, {"x": "x"}]}
    g = builder.graph_of_answers(spark.createDataFrame([(f"```json\n{json.dumps(answer)}```",), ("nothing",), (None,)], "text string"))
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert {i: "auto_generated" in r["attributes"] for i, r in nodes.items()} == {"a": False, "beta": False, "gamma": True, "x": True}
    assert nodes["a"]["attributes"]["traits"] == '["t"]' and nodes["a"]["size"] == 40.0 and nodes["beta"]["attributes"]["formula"] == ""
    edges = {(r["src"], r["dst"]): (r["label"], r["attributes"].get("auto_generated")) for r in g.edges.collect()}
    assert edges["a", "gamma"] == ("related_to", "true") and edges["a", "beta"] == ("drives", "true")
    m = builder.build_metadata(g).first()
    assert (m["total_entities"], m["auto_generated_nodes"], m["desired_relationships"]) == (4, 2, 3)
    assert m["total_relationships"] == len(edges) == m["auto_generated_edges"] and len(edges) >= 3
    empty = builder.build_metadata(builder.graph_of_answers(spark.createDataFrame([("no json",)], "text string"))).first()
    assert (empty["total_entities"], empty["total_relationships"], empty["desired_relationships"]) == (0, 0, 0)


def test_indexed_search(spark, tmp_path):
    """The same rows as a search over all nodes, reading only the postings and nodes asked for; kept up by merges."""
    import re

    labels = ["Light reaction", "light harvesting", "Highlight", "LIGHT", "Dark reaction", "reaction centre", "é light é", "lig", "li", "", None, "İstanbul light"] + [f"other label {i:03d}" for i in range(60)]
    nodes = spark.createDataFrame([(f"n{i:03d}", x, "concept" if i % 2 else "process", float(i % 7)) for i, x in enumerate(labels)], NODES)
    none = spark.createDataFrame([], EDGES)
    st = store.GraphStore(spark, f"file://{tmp_path}/g", buckets=32)
    st.merge(Graph(nodes.where("id < 'n030'"), none))
    plain = {q: [r["id"] for r in graph.search_nodes(st.read("nodes"), q).collect()] for q in ("light",)}
    st.index_labels()
    assert [r["id"] for r in st.search("light").collect()] == plain["light"]
    st.merge(Graph(nodes, none), "update")
    st.merge(Graph(nodes, none))
    st.create(Graph(spark.createDataFrame([("new", "Moonlight", "concept", 9.0)], NODES), none), "t")
    st.delete_node("n001")
    for q in ("light", "REACTION", "ight r", "li", "", "label 04", "no such", "é light"):
        for kind in (None, "concept"):
            want = [tuple(r) for r in graph.search_nodes(st.read("nodes"), q, kind).select("id", "label", "score").collect()]
            assert [tuple(r) for r in st.search(q, kind).select("id", "label", "score").collect()] == want
    assert [r["id"] for r in st.search("light", sort=False, limit=3).collect()] == ["n000", "n002", "n003"]
    files = st.candidates("moonlig").inputFiles()
    of = lambda t: {re.search(r"__bucket=(\d+)", f)[1] for f in files if f"/{t}/" in f}
    assert len(of("postings")) <= 5 and len(of("nodes")) == 1
    st.rewrite("postings")
    assert [r["id"] for r in st.search("moonlig").collect()] == ["new"]


def test_components_run_on_numbers(spark, monkeypatch):
    """Rounds see numbers in the order of ids; edges of unknown or missing ends count nothing."""
    from kgloom.operators import graph as g

    seen, plain = [], g.components

    def watched(nodes, edges, *args, **kw):
        seen.append([*nodes.schema.fields, *edges.schema.fields])
        return plain(nodes, edges, *args, **kw)

    monkeypatch.setattr(g, "components", watched)
    nodes = spark.createDataFrame([(x,) for x in ("b", "a10", "a9", "é", "Z", "b", "alone")], "id string")
    edges = spark.createDataFrame([("b", "a9"), ("a9", "a10"), ("é", "Z"), ("é", "gone"), ("gone", "b"), ("Z", "Z"), (None, "b"), ("é", "Z")], "src string, dst string")
    got = {r["id"]: r["component"] for r in g.connected(g.Graph(nodes, edges)).collect()}
    assert got == {"b": "a10", "a10": "a10", "a9": "a10", "é": "Z", "Z": "Z", "alone": "alone"}
    assert {f.dataType.simpleString() for f in seen[0]} == {"bigint"}


def test_embedding_of_odd_texts(spark, monkeypatch):
    """A text's words are summed in several steps; null texts have null components."""
    monkeypatch.setattr(extract, "_WORDS", 3)
    texts = ["a b c d e f g", "", None, "x", " y  z "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {r["k"]: r["v"] for r in df.select("k", extract.hash_embedding(F.col("t"), 8).alias("v")).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] == [None] * 8
            continue
        words = t.split(" ") if t.strip() == t else ["", "y", "z", ""]
        code = [ord(w) if w else 0 for w in words]
        raw = [sum(math.sin((h + i) * 0.01) / (j + 1) for j, h in enumerate(code)) for i in range(8)]
        n = math.sqrt(sum(x * x for x in raw))
        assert all(math.isclose(a, b / n, abs_tol=1e-9) for a, b in zip(got[k], raw, strict=True))


def test_bridge_finds_components_on_numbers(spark, monkeypatch):
    from kgloom.operators import builder
    from kgloom.operators import graph as g

    seen, plain = [], g.components
    monkeypatch.setattr(g, "components", lambda nodes, edges, *args, **kw: seen.append(edges.dtypes) or plain(nodes, edges, *args, **kw))
    nodes = spark.createDataFrame([("a", "green leaf"), ("b", "root"), ("c", "leaf area")], "id string, label string")
    edges = spark.createDataFrame([(0, "a", "b", "x", 2.0)], "pos int, src string, dst string, label string, weight double")
    got = {(r["src"], r["dst"], r["label"]) for r in builder.bridge(nodes, edges).collect()}
    assert got == {("a", "b", "x"), ("c", "a", "contextual_link")}
    assert seen == [[("a", "bigint"), ("b", "bigint")]]
