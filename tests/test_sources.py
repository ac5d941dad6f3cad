import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from kinweave.operators import closure as C
from kinweave.operators import kinship, structure, synth
from kinweave.operators.graph import violations
from kinweave.sources import files, fixtures
from kinweave.streaming.maintain import absorb, maintain

from . import model as M

VERTICES = """#id,gender,name,hop
A,-1,"One, Ann",0
B,1,"Two, Bob",1
C,-1,"Three, Cy",1
D,,"Nobody, D",1
E,1,"Five, E",9
F,1,"Six, F",2
"""
EDGES = """#child,parent
A,B,Bio
A,C,Bio
A,C,Bio
B,F,Step
C,F,Bio
B,D,Bio
C,E,Bio
"""
INVALID = "B,F,Bio,parent_cardinality\nF,A,Bio,frontier\n"


@pytest.fixture
def relationship_files(tmp_path):
    for name, text in (("v.csv", VERTICES), ("e.csv", EDGES), ("i.csv", INVALID), ("g.csv", "C,F\n")):
        (tmp_path / name).write_text(text)
    return tmp_path


def test_relationship_files(spark, relationship_files):
    p = relationship_files
    g, counts = files.read_relationships(spark, f"{p}/v.csv", f"{p}/e.csv", ["Bio"], 4)
    assert {r["external_id"]: (r["vertex_id"], r["color"], r["name"]) for r in g.vertices.collect()} == {
        "A": (0, -1, "One, Ann"), "B": (1, 1, "Two, Bob"), "C": (2, -1, "Three, Cy"), "F": (3, 1, "Six, F")
    }
    assert M.collected(g.edges) == {(0, 1): 3, (0, 2): 2, (2, 3): 3}
    assert counts == {"beyond_hop_limit": 1, "without_color": 1, "vertices": 4, "without_edges": 0}
    assert files.person_id(g, "C") == 2 and files.person_id(g, "D") is None
    more, _ = files.read_relationships(spark, f"{p}/v.csv", f"{p}/e.csv", ["Bio"], 4, f"{p}/i.csv", ["frontier"], f"{p}/g.csv")
    assert M.collected(more.edges) == {(0, 1): 3, (0, 2): 2, (1, 3): 3}
    closed = C.squaring(g.edges)
    again = files.relabel(g, structure.topological_order(closed.paths, g.vertices))
    assert again.edges.agg(structure.is_upper_triangular(None, strict=True).alias("u")).first()["u"]


def test_cache(spark, tmp_path, relationship_files):
    p = relationship_files
    g, _ = files.read_relationships(spark, f"{p}/v.csv", f"{p}/e.csv", ["Bio"], 4)
    at, about = f"{tmp_path}/cache", {"version": 1, "hops": 4}
    assert not files.cache_valid(spark, at, about)
    files.save_graph(g, at, about)
    assert files.cache_valid(spark, at, about, (f"{p}/v.csv",)) and not files.cache_valid(spark, at, about | {"hops": 5})
    assert M.collected(files.load_graph(spark, at).edges) == M.collected(g.edges)
    with pytest.raises(FileNotFoundError):
        files.load_graph(spark, f"{tmp_path}/none")


def test_database_and_exclusions(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.db")
    db.execute("CREATE TABLE VERTEX(id TEXT, given_name TEXT, surname TEXT, iteration INT)")
    db.execute("CREATE TABLE EDGE(source TEXT, destination TEXT, type TEXT)")
    db.executemany("INSERT INTO VERTEX VALUES (?, ?, ?, ?)", [("a", "A", "x", 0), ("b", "B", "x", 1), ("c", "C", "x", 7)])
    db.executemany("INSERT INTO EDGE VALUES (?, ?, ?)", [("a", "b", "Bio"), ("b", "c", "Bio")])
    db.commit()
    v, e = files.read_sqlite(spark, str(tmp_path / "g.db"), chunk=2)
    assert v.count() == 3 and e.count() == 2
    v, e = files.read_sqlite(spark, str(tmp_path / "g.db"), max_hop=2)
    assert v.count() == 2 and e.count() == 1
    (tmp_path / "x.json").write_text(json.dumps({"excluded_edges": [{"from_id": "a", "to_id": "b", "reason": "r", "comment": "c"}], "excluded_vertices": [{"vertex_id": "c", "reason": "q"}]}))
    edges, vertices = files.read_exclusions(spark, str(tmp_path / "x.json"))
    assert edges.first()["to_id"] == "b" and vertices.first()["vertex_id"] == "c"


def test_matrix_as_text_and_table(spark, tmp_path):
    m = structure.identity(spark.createDataFrame([(0, -1), (1, 1)], "vertex_id long, color int")).unionByName(spark.createDataFrame([(1, 0, 12)], "i long, j long, v long"))
    assert files.capture(m, 2) == "[\n  [-1, 0],\n  [12, 1]\n]"
    files.write_matrix_csv(m, 2, f"{tmp_path}/m")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/m", header=True).collect()] == [("0", "1", "0"), ("1", "12", "1")]


@pytest.mark.parametrize("bad", [{"num_initial_nodes": 0}, {"pct_red": 101}, {"consanguinity_depth": 4}, {"child_distribution": "x"}, {"child_dispersion": 0}, {"max_total_vertices": 0}])
def test_synthesizer_settings(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        synth.SynthesizerConfig(**({"num_initial_nodes": 5} | bad))


def test_synthesized_families(spark, tmp_path):
    config = synth.SynthesizerConfig(24, num_generations=2, seed=3, pct_immigration_per_gen=20)
    one, two = synth.synthesize(spark, config), synth.synthesize(spark, config)
    rows = sorted(map(tuple, one.individuals.collect()), key=lambda r: r[0])
    assert rows == sorted(map(tuple, two.individuals.collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == list(range(one.stats["total"])) and len(rows) > 24
    assert violations(one.graph, ordered=True).isEmpty()
    couples = one.individuals.where("father_id is not null").selectExpr("father_id as a", "mother_id as b").distinct()
    paths = C.transitive_closure(one.graph.edges).paths
    assert kinship.related_within(paths, couples, config.consanguinity_depth).isEmpty()
    files.write_synthesis(one, f"{tmp_path}/s")
    g, _ = files.read_relationships(spark, f"{tmp_path}/s/vertices", f"{tmp_path}/s/edges", ["parent-child"], 99)
    assert g.edges.count() == one.graph.edges.count() and g.vertices.count() == len(rows)
    capped = synth.synthesize(spark, synth.SynthesizerConfig(20, num_generations=3, seed=1, max_total_vertices=30))
    assert capped.individuals.count() <= 30


def test_child_distributions():
    for kind in ("poisson", "negative_binomial"):
        shares = synth.child_shares(synth.SynthesizerConfig(5, avg_children_per_pairing=2.0, child_distribution=kind))
        assert abs(sum(1 - s for s in shares) - 2.0) < 0.01
    assert synth.child_shares(synth.SynthesizerConfig(5, avg_children_per_pairing=0.0))[0] == 1.0


def test_absorbing_edges_equals_closing_again(spark):
    g = fixtures.part_graph(spark, "/root/testdata/sf0.001")
    small = g.edges.where("i < 60")
    old, new = small.where("i % 3 <> 1"), small.where("i % 3 = 1")
    got = absorb(C.squaring(old).paths, new)
    assert M.collected(got) == M.collected(C.squaring(small).paths)


def test_absorbing_by_steps_in_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_EDGES", 4)
    schema = "i long, j long, v long"
    edges = [(5, 4, 2), (4, 3, 3), (3, 2, 2), (2, 1, 2), (1, 0, 3), (5, 2, 3)]
    whole = M.collected(C.squaring(spark.createDataFrame(edges, schema)).paths)
    # The last batch replaces old paths by lesser ones, 5 to 2 among them.
    for new in ([(4, 3, 3), (2, 1, 2)], [(5, 2, 3)]):
        old = C.squaring(spark.createDataFrame([e for e in edges if e not in new], schema)).paths
        got = C.absorbed(old, spark.createDataFrame(new, schema))
        assert got.count() == len(whole) and M.collected(got) == whole
    # An old edge of two steps is no path of steps: the general way takes it.
    long = spark.createDataFrame([(7, 5, 6)], schema)
    assert C.absorbed(long, spark.createDataFrame(new, schema)) is None
    assert M.collected(absorb(long, spark.createDataFrame(new, schema))) == {(7, 5): 6, (5, 2): 3, (7, 2): 13}


def test_streamed_closure(spark, tmp_path):
    schema = "i long, j long, v long"
    for k, part in enumerate(([(2, 1, 2), (1, 0, 3)], [(3, 2, 3), (4, 1, 2)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = maintain(stream, f"{tmp_path}/state", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    want = {(2, 1): 2, (1, 0): 3, (2, 0): 5, (3, 2): 3, (3, 1): 6, (3, 0): 13, (4, 1): 2, (4, 0): 5}
    assert M.collected(spark.read.parquet(f"{tmp_path}/state/1")) == want
