"""Operators of the engine on small, hand-made cases."""

import json
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.functions import scalars as S
from quarry.operators import components, extract, graph, joins, knn, pagerank, resolve, search, services
from quarry.sources import files, pdf, store


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["abc:MNIST", "Größe: 日本", "", "x" * 300])
def test_uuid5(spark, name):
    assert one(spark, S.uuid5_hex(F.lit(name))) == uuid.uuid5(uuid.NAMESPACE_URL, name).hex


def test_ids(spark):
    assert one(spark, S.dataset_id(F.lit("abc"), F.lit(None).cast("string"))) == uuid.uuid5(uuid.NAMESPACE_URL, "abc:None").hex
    for h in (uuid.uuid4().hex, "f" * 32, "0" * 32):
        assert one(spark, S.low63(F.lit(h))) == int(h, 16) & (2**63 - 1)


@pytest.mark.parametrize(("title", "want"), [("The MS-COCO (2017) Dataset!", "ms-coco 2017"), ("Größe-Corpus der ä data", "größe- der ä"), ("data-set A  b", "-set b"), (None, "")])
def test_title(spark, title, want):
    assert one(spark, S.normalize_title(F.lit(title).cast("string"))) == want
    if title:
        plain = re.sub(r"\s+", " ", re.sub(r"\b(a|the|an|dataset|corpus|data)\b", "", re.sub(r"[^\w\s-]", "", title.lower()))).strip()
        assert plain == want


def test_keywords(spark):
    assert one(spark, S.parse_keywords(F.lit("vision, , detection."))) == ["vision", "detection"] == services.keywords_in("vision, , detection.")
    assert one(spark, S.parse_keywords(F.lit(""))) == [] == services.keywords_in("")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert one(spark, S.keyword_overlap(words("a", "b", "b"), words("b", "c", "d"))) == 0.5
    assert one(spark, S.keyword_overlap(words(), words("a"))) == 0.0


@pytest.mark.parametrize(("reply", "want"), [('Sure: [{"a":1}] ok', [{"a": 1}]), ('{"datasets_used": true}', {"datasets_used": True}), ('x {"a\\_b": 1 // note\n} y', {"a_b": 1}), ('{"a": [1, 2]}', [1, 2]), ("nothing", None), ('["a\nb"]', ["a\nb"])])
def test_json_in_reply(reply, want):
    assert services.json_in_reply(reply) == want


def test_chat_extractor_and_judge():
    replies = iter(['{"datasets_used": true}', '[{"title": "T", "description": "D", "task": "K", "link": "None"}]', "a, b."])
    assert services.chat_extractor(lambda m: next(replies))("text") == {"datasets_used": True, "datasets": [{"title": "T", "description": "D", "task_description": "K", "link": "None", "task": ["a", "b"]}]}
    assert services.chat_extractor(lambda m: '{"datasets_used": false}')("text") == {"datasets_used": False, "datasets": []}
    assert services.chat_judge(lambda m: 'ok {"is_same": true}')({}, {}) is True
    assert services.chat_judge(lambda m: "no idea", retries=1)({}, {}) is None
    calls = []
    with pytest.raises(ValueError):
        services.with_retries(lambda: calls.append(1) or int("x"), 3, 0.0)()
    assert len(calls) == 3


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("héllo")
    (tmp_path / "sub" / "b.md").write_text("héllo")
    (tmp_path / "c.html").write_text("<b>x</b>")
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "f.pdf").write_bytes(b"pdf")
    found = files.scan_folder(spark, str(tmp_path))
    texts, failed = files.load_texts(found)
    assert sorted(r.text for r in texts.collect()) == ["<b>x</b>", "héllo"]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in failed.collect()} == {"d.bin": "unsupported extension", "e.txt": "not UTF-8", "f.pdf": "no PDF reader"}
    texts, failed = files.load_texts(found, lambda b: "from " + b.decode())
    assert "from pdf" in {r.text for r in texts.collect()} and failed.count() == 2
    assert files.filename_map(found).count() == 5


def tiny_pdf(pages):
    """A PDF of pages of (font size, text) lines, with deflated streams."""
    out = [b"%PDF-1.4"]
    for k, lines in enumerate(pages):
        body = b"BT " + b" ".join(b"/F1 %d Tf 0 -14 Td (%s) Tj" % (size, text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for size, text in lines) + b" ET"
        body = zlib.compress(body)
        out.append(b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % (k + 4, len(body)) + body + b"\nendstream endobj")
    return b"\n".join([*out, b"%%EOF"])


def test_pdf():
    content = tiny_pdf([[(20, "Title (one)"), (10, "We use the Open Set dataset."), (10, "More text é here.")], [(10, "Second page")]])
    assert pdf.pdf_text(content) == "Title (one)\nWe use the Open Set dataset.\nMore text é here.\nSecond page"
    assert pdf.pdf_markdown(content).startswith("# Title (one)\nWe use") and "\n\nSecond page" in pdf.pdf_markdown(content)
    assert pdf.pdf_text(b"%PDF-1.4\n<< /Length 9 >> stream\nBT [(Hel) 20 (lo) -300 (you)] TJ T* <FEFF00e9> Tj ET\nendstream") == "Hello you\né"
    for broken in (b"pdf", b"%PDF-1.4 nothing", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(ValueError):
            pdf.pdf_text(broken)


def test_pdf_failures_are_told(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(tiny_pdf([[(10, "A page")]]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    texts, failed = files.load_texts(files.scan_folder(spark, str(tmp_path)), pdf.pdf_text, 2)
    assert [r.text for r in texts.collect()] == ["A page"] and [r.reason for r in failed.collect()] == ["ValueError: no PDF"]


def test_graphml_of_other_tools(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="type" attr.type="string" />
  <key id="d1" for="node" attr.name="aliases" attr.type="string"/>
  <key id="d2" for="edge" attr.name="weight" attr.type="double"/>
  <key id="d3" for="edge" attr.name="type" attr.type="string"/>
  <graph edgedefault="undirected">
    <node id="b">
      <data key="d0">dataset</data>
      <data key="d1">x,y</data>
    </node>
    <node id="a&amp;c"><data key="d0">task</data></node>
    <edge source="b" target="a&amp;c">
      <data key="d2">0.5</data>
      <data key="d3">used_for_task</data>
    </edge>
  </graph>
</graphml>""")
    nodes, edges = store.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.id, r.type, r.aliases) for r in nodes.collect()) == [("a&c", "task", []), ("b", "dataset", ["x", "y"])]
    assert [tuple(r) for r in edges.collect()] == [("a&c", "b", "used_for_task", 0.5)]


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace(spark.range(3).select("id"), path)
    store.replace(store.read_table(spark, path, "id long").filter("id > 0"), path)
    assert sorted(r.id for r in store.read_table(spark, path, "id long").collect()) == [1, 2]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two moves
    assert store.read_table(spark, path, "id long").count() == 2


def test_unreadable_tables_read_as_empty(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"no parquet at all, but long enough")
    assert store.read_table(spark, str(tmp_path / "t"), "id long").count() == 0


def test_decomposition_and_prompts():
    assert services.decompose("t", lambda m: '{"is_specific": false, "tasks": ["a", " b "]}') == ["a", "b"]
    assert services.decompose("t", lambda m: "what?") == services.decompose("t", lambda m: '{"is_specific": true, "tasks": ["x"]}') == ["t"]
    seen = []
    services.chat_extractor(lambda m: seen.append(m[0]["content"]) or '{"datasets_used": false}', {"existence": "Any data?"})("text")
    assert seen == ["Any data?"]


def test_spread_join(spark):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 99), (3, 98)], "k int, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, name string")
    heavy = joins.heavy_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], 4)
    assert [r.k for r in heavy.collect()] == [1]
    got = joins.spread_join(left, right, ["k"], heavy, "v", ["name"])
    assert "_salt" in re.search(r"hashpartitioning\(([^)]*)", got._jdf.queryExecution().executedPlan().toString())[1]  # what spreads a heavy key
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1, k, "a") for k in range(50)] + [(2, 99, "b")])


def test_import(spark):
    d = lambda t, k: {"title": t, "description": "d", "task_description": k, "link": None, "task": ["w"]}
    rows = [("f1", True, [d("A", "k1"), d("A", "k2"), d("A", "k1"), d(None, "k3")]), ("f2", False, [d("B", "k")]), ("f3", True, None), ("f4", None, [])]
    ex = spark.createDataFrame(rows, "fingerprint string, datasets_used boolean, datasets array<struct<title:string,description:string,task_description:string,link:string,task:array<string>>>")
    documents, datasets, tasks = store.import_extractions(ex)
    assert {r.id for r in documents.collect()} == {"f1", "f3", "f4"}
    assert datasets.count() == 2 and tasks.count() == 3
    assert datasets.join(store.import_extractions(ex)[1].select("id"), "id", "left_anti").count() == 0


def test_import_apart(spark):
    """One row a fingerprint, none of an id's form: the same tables and graph, without a shuffle."""
    d = lambda t, k, n="d": {"title": t, "description": n, "task_description": k, "link": None, "task": ["w"]}
    rows = [("f1", True, [d("A", "k1"), d("A", "k2", "e"), d("A", "k1", "f"), d(None, "k3"), d("None", "k3"), d("None", None), d("A", "None"), None]), ("f2", False, [d("B", "k")]), ("f3", True, None), ("f4", None, []), ("f5", None, [d("B", "k")])]
    ex = spark.createDataFrame(rows, "fingerprint string, datasets_used boolean, datasets array<struct<title:string,description:string,task_description:string,link:string,task:array<string>>>")
    got, want = store.import_apart(ex), store.import_extractions(ex)
    for x, y in zip(got, want, strict=True):
        assert x.columns == y.columns and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    for x, y in zip(graph.build_graph(*got, apart=True), graph.build_graph(*want), strict=True):
        assert x.columns == y.columns and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
        assert "Exchange" not in planned(x)
    assert sorted(map(str, graph.degrees_apart(*got[1:]).collect())) == sorted(map(str, graph.degrees(graph.build_graph(*want)[1]).collect()))


def test_lines_are_dealt_before_they_are_listed(spark, sf_dir):
    from quarry.plans import queries

    plan = planned(queries.extractions(spark, sf_dir)).split("== Initial Plan")[0]
    assert "REPARTITION_BY_COL" in plan and not re.search(r"Aggregate.*partial_collect_list[^\n]*\n(?:[^\n]*Project[^\n]*\n)*[^\n]*Join", plan)


@pytest.mark.parametrize("query", ["kg_nodes", "kg_edges"])
def test_graph_of_orders_is_not_shuffled(spark, sf_dir, query):
    from quarry.plans import queries

    assert "Exchange" not in planned(queries.QUERIES[query](spark, sf_dir))  # once the extractions are written


def test_components_by_key(spark):
    """Merging by a key is what components, contraction and representatives make of edges between equal keys."""
    rows = [(f"{k:02}", str(k % 4), f"T{k % 5 if k < 15 else k}") for k in range(20)] + [("x", "1", None)]
    sets = spark.createDataFrame(rows, "id string, document_id string, title string")
    keyed = components.by_key(sets, "title")
    pairs = sets.alias("a").join(sets.alias("b"), "title").select(F.col("a.id").alias("lo"), F.col("b.id").alias("hi"))
    found = {r.id: r.component for r in components.connected_components(pairs, "lo", "hi").collect()}
    assert {r.id: r.component for r in keyed.collect()} == {i: found.get(i, i) for i, _, t in rows if t}
    nodes, edges = graph_of(spark, [(i, "dataset", []) for i, *_ in rows], [])
    merged = graph.contract(nodes, edges, keyed.select("id", "component"))[0]
    known = sets.filter("title is not null")
    assert sorted(map(str, graph.document_counts(keyed.withColumnRenamed("component", "representative")).collect())) == sorted(map(str, graph.document_counts(known, merged).collect()))


def test_contraction_runs_are_bounded(monkeypatch):
    """A task's forests are of so many edges at a time, whatever its partition holds."""
    import pyarrow as pa

    sizes, forest = [], components.forest
    monkeypatch.setattr(components, "RUN", 10, raising=False)
    monkeypatch.setattr(components, "forest", lambda pairs: forest(sizes.append(len(p := list(pairs))) or p))
    batches = [pa.RecordBatch.from_pydict({"a": [k] * 4, "b": list(range(k + 1, k + 5))}) for k in range(0, 40, 4)] + [pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})]
    out = [p for b in components._contract(iter(batches)) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    assert max(sizes) <= 10 and sum(sizes) == 40 and {x: 0 for x in range(1, 41)} == forest(out)
    assert list(components._contract(iter([]))) == []


def test_read_extractions_and_benchmark(spark, tmp_path):
    (tmp_path / "abc.json").write_text(json.dumps({"datasets_used": True, "datasets": [{"title": "T"}]}))
    (tmp_path / "bad.json").write_text("{nope")
    good, bad = store.read_extractions(spark, str(tmp_path))
    assert [(r.fingerprint, r.datasets[0].title) for r in good.collect()] == [("abc", "T")] and [r.fingerprint for r in bad.collect()] == ["bad"]
    (tmp_path / "b.csv").write_text('﻿task,ground_truth,link\n"find ""it"", now",GSM,\nx,y,http://z\n', encoding="utf-8")
    assert [tuple(r) for r in store.read_benchmark(spark, str(tmp_path / "b.csv")).collect()] == [('find "it", now', "GSM", None), ("x", "y", "http://z")]


def graph_of(spark, nodes, edges):
    return spark.createDataFrame([(i, t, a) for i, t, a in nodes], "id string, type string, aliases array<string>"), spark.createDataFrame(edges, "src string, dst string, type string, weight double")


def test_contraction(spark):
    nodes, edges = graph_of(spark, [(x, "dataset", []) for x in "xyz"] + [("d1", "document", []), ("t1", "task", [])], [("d1", "y", "c", None), ("d1", "z", "c", None), ("t1", "z", "u", None), ("x", "y", "s", 1.0)])
    comp = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "x"), ("p", "o"), ("o", "o")], "id string, component string")
    n, e = graph.contract(nodes, edges, comp)
    assert {r.id: r.aliases for r in n.collect()} == {"x": ["y", "z"], "d1": [], "t1": []}
    assert sorted((r.src, r.dst) for r in e.collect()) == [("d1", "x"), ("t1", "x")]
    assert {r.id: r.representative for r in graph.representatives(n).collect()} == dict.fromkeys("xyz", "x")
    assert {(r.src, r.dst) for r in graph.contract(n, e, comp)[1].collect()} == {("d1", "x"), ("t1", "x")}
    lines = store.graphml(n.withColumn("type", F.concat("type", F.lit('<"&'))), e.withColumn("weight", F.lit(0.5)))
    n2, e2 = store.parse_graphml(lines)
    assert {r.id: (r.type, r.aliases) for r in n2.collect()} == {"x": ('dataset<"&', ["y", "z"]), "d1": ('document<"&', []), "t1": ('task<"&', [])}
    assert [r.weight for r in e2.collect()] == [0.5, 0.5]


def test_statistics(spark):
    sets = spark.createDataFrame([("a", "d1", "A", "", ""), ("b", "d2", "B", "", ""), ("c", "d2", "C", "", "")], "id string, document_id string, title string, description string, link string")
    nodes, _ = graph_of(spark, [("a", "dataset", ["b"]), ("c", "dataset", [])], [])
    assert {(r.document_id, r.title): r.doc_count for r in graph.document_counts(sets, nodes).collect()} == {("d1", "A"): 2, ("d2", "B"): 2, ("d2", "C"): 1}
    assert {r.doc_count for r in graph.document_counts(sets).collect()} == {1}


@pytest.mark.parametrize("local", [True, False])
def test_pagerank(spark, local):
    nodes, edges = graph_of(spark, [(x, "task", []) for x in "abcd"], [("a", "b", "s", 1.0), ("b", "c", "s", 0.65)])
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {r.id: r.score for r in pagerank.pagerank(nodes, edges, seeds, max_iter=25 if not local else 100, local=local).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    for k, v in {"a": 0.386375, "b": 0.459472, "c": 0.154003, "d": 0.000150}.items():
        assert abs(got[k] - v) < (1e-5 if local else 0.02)
    flat = {r.id: r.score for r in pagerank.pagerank(nodes, edges, spark.createDataFrame([("zz",)], "id string"), local=local, max_iter=5).collect()}
    assert abs(sum(flat.values()) - 1) < 1e-9 and flat["b"] > flat["d"] > 0


@pytest.mark.parametrize("local", [True, False])
def test_pagerank_to_convergence(spark, local):
    """Against a plain power iteration; an edge without a weight is none."""
    edges = [("a", "b", "s", 1.0), ("b", "c", "s", 0.65), ("c", "e", "s", 0.2), ("a", "c", "s", None)]
    nodes, rows = graph_of(spark, [(x, "task", []) for x in "abcde"], edges)
    got = {r.id: r.score for r in pagerank.pagerank(nodes, rows, local=local).collect()}
    weight = {}
    for a, b, _, w in edges:
        if w:
            weight[a, b] = weight[b, a] = w
    rank = dict.fromkeys("abcde", 0.2)
    for _ in range(100):
        new = {x: 0.15 / 5 + 0.85 * rank["d"] / 5 for x in rank}
        for (a, b), w in weight.items():
            new[b] += 0.85 * rank[a] * w / sum(v for (x, _), v in weight.items() if x == a)
        change, rank = sum(abs(new[x] - rank[x]) for x in rank), new
        if change < 5e-6:
            break
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in rank)


def test_task_edges(spark):
    unit = lambda c: [c, float(np.sqrt(1 - c * c)), 0.0]
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", unit(0.81)), ("c", [0.0, 0.0, 1.0])], "hex_id string, embedding array<double>")
    tasks = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", None)], "id string, keywords array<string>")
    nodes, edges = graph_of(spark, [(x, "task", []) for x in "abc"], [])
    got = graph.task_edges(vectors, tasks, nodes, edges).collect()
    assert [(r.src, r.dst, r.weight) for r in got] == [("a", "b", 1.0)]
    got = graph.task_edges(vectors, tasks, nodes, edges, strong=0.9).collect()
    assert abs(got[0].weight - 0.81) < 1e-9
    tasks = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"])], "id string, keywords array<string>")
    assert graph.task_edges(vectors, tasks, nodes, edges, strong=0.9).first().weight == 1.0


@pytest.mark.parametrize("block", [4096, 7])
def test_knn(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.standard_normal((30, 8)), np.ones((5, 8))])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(99, None)], "hex_id long, embedding array<double>")
    got = {(r.a, r["rank"]): r.b for r in knn.topk_join(df, df, 4).collect()}
    s = x @ x.T
    want = {(a, n + 1): b for a in range(35) for n, b in enumerate(sorted(range(35), key=lambda b: (-round(s[a, b], 9), b))[:4])}
    assert got == want
    top = knn.topk_query(df, [1.0] * 8, 3).collect()
    assert [r.id for r in top] == sorted(range(35), key=lambda b: (-round(x[b].sum(), 9), b))[:3]


def planned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_does_not_shuffle_blocks(spark, monkeypatch):
    """Many blocks: only what each task found best is shuffled, k rows a left row from each task that saw it."""
    monkeypatch.setattr(knn, "BLOCK", 5)
    x = np.random.default_rng(3).standard_normal((60, 8))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "hex_id long, embedding array<double>")
    got = knn.topk_join(df, df, 2)
    plan = planned(got)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("== Initial Plan")[0])
    assert "CartesianProduct" in plan and len(dealt) == 1 and dealt[0].startswith("a#")
    assert {(r.a, r["rank"]): r.b for r in got.collect()} == {(a, n + 1): b for a, row in enumerate(x @ x.T) for n, b in enumerate(np.argsort(-row, kind="stable")[:2])}


def test_knn_ties_wherever_vectors_are(spark, monkeypatch):
    """Equal vectors in blocks of odd sizes have equal scores, sums in the vectors' order; ids may be text."""
    monkeypatch.setattr(knn, "BLOCK", 11)
    base = np.random.default_rng(4).standard_normal((9, 61)).astype(np.float32)
    df = spark.createDataFrame([(f"{k:03}", [float(v) for v in base[k % 9]]) for k in range(90)], "hex_id string, embedding array<float>")
    got = knn.topk_join(df, df, 4).collect()
    assert {r.a: r.b for r in got if r["rank"] == 4} == {f"{k:03}": f"{k % 9 + 27:03}" for k in range(90)}
    assert all(r.sim == np.cumsum(base[int(r.a) % 9].astype(float) ** 2)[-1] for r in got)
    big = [[1e300, 0.0], [float("nan"), 1.0], [1.0, 2.0], [1e-200, 1e-200]]
    odd = spark.createDataFrame(list(enumerate(big)), "hex_id long, embedding array<double>")
    assert {(r.a, r["rank"]): r.b for r in knn.topk_join(odd, odd, 1).collect()} == {(0, 1): 0, (2, 1): 0, (3, 1): 0}


def test_only_mild_pairs_need_keywords(spark):
    unit = lambda c: [c, float(np.sqrt(1 - c * c)), 0.0]
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", unit(0.9)), ("c", [0.0, 0.0, 1.0]), ("d", [0.0, 0.8, 0.6])], "hex_id string, embedding array<double>")
    tasks = spark.createDataFrame([(x, [x, "w"]) for x in "abcdefgh"], "id string, keywords array<string>")
    nodes, edges = graph_of(spark, [(x, "task", []) for x in "abcd"], [])
    got = graph.task_edges(vectors, tasks, nodes, edges, overlap=0.5)
    assert sorted((r.src, r.dst, r.weight) for r in got.collect()) == [("a", "b", 1.0), ("c", "d", 1.0)]
    assert "LeftSemi" in planned(got)  # of the keywords only those of pairs whose similarity leaves it open


def test_seeds(spark):
    near = lambda *c: spark.createDataFrame([(k, v, v) for k, v in enumerate(c)], "id int, sim double, cos double")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.seeds(near(0.9, 0.85, 0.7), 2)) == [0, 1]
    assert ids(search.seeds(near(0.7, 0.65), 2)) == [0]
    assert ids(search.seeds(near(*[0.8 - 0.02 * k for k in range(9)]), 9)) == [0, 1, 2]
    assert ids(search.seeds(near(0.5), 2)) == []
    assert [search.candidate_count(k) for k in (0, 1, 3, 5, 10)] == [0, 3, 27, 60, 150]
    assert search.wanted(5, 0.5) == 5 and search.wanted(3, 1.5) == 5


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1400)] + [(5, 5), (None, 3)]
    found = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    parent = components.forest((a, b) for a, b in edges if a is not None)
    nodes = {x for e in edges if e[0] != e[1] and None not in e for x in e}
    assert found == {x: parent.get(x, x) for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_resolution(spark):
    sets = spark.createDataFrame([("1", "COCO Dataset"), ("2", "The coco"), ("3", "MS COCO"), ("4", "CIFAR-10"), ("5", "CIFAR-100"), ("6", None)], "id string, title string").withColumns({"description": F.lit("d"), "link": F.lit("None")})
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("4", "5"), ("5", "6"), ("1", "3")], "lo string, hi string")
    asked = lambda a, b: {("The coco", "MS COCO"): True, ("COCO Dataset", "MS COCO"): True, ("CIFAR-10", "CIFAR-100"): False}.get((a["title"], b["title"]))
    comp, aliases, different = resolve.resolve(pairs, sets, asked)
    assert {r.id: r.component for r in comp.collect()} == {"1": "1", "2": "1", "3": "1"}
    assert {(r.key, r.target) for r in aliases.collect()} == {("coco", "1"), ("ms coco", "1")}
    assert [tuple(r) for r in different.collect()] == [("4", "5")]
    again = resolve.resolve(pairs, sets, lambda a, b: None, aliases, different)
    assert {r.id: r.component for r in again[0].collect()} == {"1": "1", "2": "1", "3": "1"} and again[2].count() == 0


def test_engine(spark, tmp_path):
    from quarry import cli
    from quarry.plans.engine import Engine
    from quarry.streaming.incremental import watch

    docs = tmp_path / "docs"
    docs.mkdir()
    topics = ["machine translation of news", "translation of news between languages", "image labels for street scenes", "protein folding"]
    for k, t in enumerate(topics):
        (docs / f"p{k}.txt").write_text(f"We use the Open Set{k // 2} dataset from https://x.org/{k} here. The task is {t}. Thanks.")
    (docs / "bad.xyz").write_text("?")
    (docs / "paper.pdf").write_bytes(tiny_pdf([[(10, "We use the Portable Set dataset here. The task is layout of pages.")]]))
    options = {"input_folder": str(docs), "cache_root": str(tmp_path / "cache"), "embedding_dimension": 128, "weak_similarity_threshold": 0.3, "similarity_threshold": 0.5, "min_seed_similarity": 0.2}
    engine = Engine(spark, **options)
    assert [r.reason for r in engine.build().collect()] == ["unsupported extension"]
    counts = {t: engine.table(t).count() for t in ("preprocessed", "extractions", "documents", "datasets", "tasks", "task_vectors", "nodes", "edges", "task_nodes")}
    assert counts["documents"] == counts["datasets"] == counts["tasks"] == counts["task_nodes"] == 5
    assert engine.counts(processed=False) == {"node document": 5, "node dataset": 5, "node task": 5, "edge contains_dataset": 5, "edge used_for_task": 5}
    assert {r.stage: r.rows for r in engine.progress().collect()}["preprocessed"] == 5
    engine.build()
    assert counts == {t: engine.table(t).count() for t in counts}
    hits = engine.search("The task is machine translation of news.", 2).collect()
    assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and "Set0" in hits[0].title
    assert "Related Tasks" in engine.qa("The task is protein folding.", 1) and engine.statistics().count() == 5
    assert engine.search("x", 0).count() == 0
    engine.export_graphml(str(tmp_path / "kg"))
    n, e = store.parse_graphml(spark.read.text(str(tmp_path / "kg")))
    assert n.count() == engine.table("processed_nodes").count() and e.count() == engine.table("processed_edges").count()
    (docs / "new.txt").write_text("The Great Corpus benchmark is new. Parsing of trees.")
    watch(engine, str(docs), str(tmp_path / "stream")).awaitTermination(120)
    assert engine.table("documents").count() == 6
    assert "Great" in engine.search("Parsing of trees.", 1).first().title  # the stream ends in a searchable graph
    assert engine.table("filename_map").filter("path like '%new.txt'").count() == 1 and engine.table("failed").count() == 1
    cli.main(["stats", "--cache-root", options["cache_root"]], spark)
    with pytest.raises(ValueError):
        Engine(spark, cache_root=str(tmp_path)).build()


def test_embedding_and_texts(spark):
    x = services.hash_embedder(64)(["a b", "a b", "", "c"])
    assert (x[0] == x[1]).all() and not x[2].any() and abs(np.linalg.norm(x[3]) - 1) < 1e-6
    rows = spark.createDataFrame([("1", "t", None), ("2", None, "d "), ("3", "", ""), ("", "t", "d")], "id string, title string, description string")
    assert {r.id: r.text for r in extract.dataset_texts(rows).collect()} == {"1": "t None", "2": "None d"}
