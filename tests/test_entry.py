"""The entry, and queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A cross-section; all of them are compared by the driver.
CHECKED = [
    "avos_sum", "avos_product", "generation_msb", "traversal_path", "decode_relationship", "vec_avos", "row_vector_product", "matmul", "product_pattern",
    "einsum_chain", "einsum_outer", "transitive_closure", "path_predecessors", "path_vertices", "vertex_composition", "edge_composition", "kinship_pairs",
    "topological_sort", "canonical_ordering", "validate_graph", "closure_row_stats", "mutual_exclusions", "enumerate_cycles", "edge_reliability", "to_dense",
    "consanguinity_label", "algebra_laws", "cycle_detect", "is_upper_triangular", "dist_matrix", "shortest_path_methods", "closure_multi_source_min",
]


def rows(frame, columns):
    held = frame[columns].astype(object)
    return sorted(map(repr, held.where(frame[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"synthesize_family"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_the_training_data_operators(tmp_path):
    """Nothing outside imports the subpackage: hide it and load everything else."""
    code = (
        "import sys, importlib, pkgutil\n"
        "class Hidden:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('kinweave.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hidden())\n"
        "import __spark_entry__ as e, kinweave\n"
        "for m in pkgutil.walk_packages(kinweave.__path__, 'kinweave.'):\n"
        "    if not m.name.startswith('kinweave.llm') and not m.name.endswith('__main__'):\n"
        "        importlib.import_module(m.name)\n"
        "assert e.queries() and not any(q.startswith('op') for q in e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
