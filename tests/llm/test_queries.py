"""What the subpackage registers, and the SQL of those results that SQL can express."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from mailspark.llm import queries
from tools.check_oracle import TABLES, TYPE_MAP, rows_of

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.QUERIES.items() <= E.queries().items() and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    kinds = dict(zip(cols, [str(t) for t in con.sql(queries.ORACLE[name]).types]))
    assert {c: TYPE_MAP.get(t, t) for c, t in df.dtypes} == kinds
    assert rows_of(df.columns, df.collect()) == rows_of(cols, con.execute(queries.ORACLE[name]).fetchall())


def test_the_rest_works_without_the_subpackage():
    """The entry module leaves the corpus queries out where the subpackage or the pipeline is gone, and only then."""
    import subprocess
    import sys

    code = ("import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n"
            "        if name == '{gone}': raise ModuleNotFoundError('gone', name=name)\n"
            "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as E\nq = E.queries()\n"
            "assert 'prune' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')], list(q)\nE.oracle_sql()")
    root = E.__file__.rsplit("/", 1)[0]
    for gone in ("mailspark.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(gone=gone)], cwd=root, check=True, timeout=120)
    out = subprocess.run([sys.executable, "-c", code.format(gone="mailspark.llm.minhash")], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode and "minhash" in out.stderr
