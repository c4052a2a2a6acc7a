"""Rows that can't be trained on or decoded leave the others as they are, in every query of hidden Markov models."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqloom.operators import hmm
from seqloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
BY_ROW = ["hmm_decode", "hmm_contexts", "hmm_definitions", "hmm_n_best", "hmm_lattice", "hmm_rescored", "hmm_tuned"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with eight odd vectors more; the last is in order but has no label."""
    folder = tmp_path_factory.mktemp("odd")
    shutil.copytree(SF, folder, dirs_exist_ok=True)
    table = pq.read_table(f"{SF}/embeddings.parquet")
    rows = table.to_pylist()
    v, top = rows[0]["embedding"], max(r["vec_id"] for r in rows) + 1
    vectors = [None, [], v[:63], [*v[:60], None, None, None, None], [*v[:63], float("nan")], [*v[:63], float("inf")], v[:8], v]
    more = [{"vec_id": top + i, "embedding": x, "label": i % 10 if i < 7 else None} for i, x in enumerate(vectors)]
    (folder / "embeddings.parquet").chmod(0o644)
    pq.write_table(pa.Table.from_pylist(rows + more, schema=table.schema), folder / "embeddings.parquet")
    return str(folder), top


@pytest.mark.parametrize("name", BY_ROW)
def test_odd_rows_leave_the_others_as_they_are(spark, odd, name):
    folder, top = odd
    found = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
    if name in ("hmm_tuned", "hmm_rescored"):  # the first searches over folds, the other counts the labels of all rows
        assert {r["utterance_id"] for r in found} == set(range(top + 8))
        assert all(not r["decoded"] for r in found if top <= r["utterance_id"] < top + 7)
        return
    key = lambda r: str(sorted(r.items()))
    want = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert sorted((r for r in found if r["utterance_id"] < top), key=key) == sorted(want, key=key)
    shown = [r for r in found if r["utterance_id"] >= top and (r.get("decoded") or r.get("token"))]
    assert {r["utterance_id"] for r in shown} == {top + 7}


@pytest.mark.parametrize("name", ["state_trees", "hmm_beam_recall"])
def test_odd_rows_in_summaries(spark, odd, name):
    folder, top = odd
    found, want = QUERIES[name](spark, folder).collect(), QUERIES[name](spark, SF).collect()
    if name == "state_trees":
        assert sorted(map(str, found)) == sorted(map(str, want))
    else:
        assert {r["beam"] for r in found} == {r["beam"] for r in want}
        assert all(r["recall"] <= 1 and r["links"] > 0 for r in found)


@pytest.mark.parametrize("name", ["hmm_decode", "hmm_definitions", "hmm_lattice", "hmm_n_best", "hmm_rescored"])
def test_tasks_without_rows_end_no_query(spark, tmp_path, name):
    """A split of a file that begins no row group is a task without rows; so is a table without rows."""
    settings = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    want = QUERIES[name](spark, SF).count()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert QUERIES[name](spark, SF).count() == want > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shutil.copytree(SF, tmp_path / "t")
    (tmp_path / "t/embeddings.parquet").chmod(0o644)
    pq.write_table(pq.read_table(f"{SF}/embeddings.parquet").slice(0, 0), tmp_path / "t/embeddings.parquet")
    assert QUERIES[name](spark, str(tmp_path / "t")).collect() == []


def test_labels_below_zero_have_contexts(spark, tmp_path):
    """Their tokens hold the sign that divides a name from its left neighbour."""
    shutil.copytree(SF, tmp_path / "t")
    table = pq.read_table(f"{SF}/embeddings.parquet")
    rows = [r | {"label": -1 - r["label"]} for r in table.to_pylist()]
    (tmp_path / "t/embeddings.parquet").chmod(0o644)
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), tmp_path / "t/embeddings.parquet")
    found = QUERIES["hmm_contexts"](spark, str(tmp_path / "t")).collect()
    assert len(found) == len(rows)
    assert {t for r in found for t in (r["decoded"] or "").split()} <= {"0", "-1", "-2", "3", "4"}
    assert any("-" in (r["decoded"] or "") for r in found)


def test_names_with_neighbours_are_read_back():
    for left, centre, right in [(None, "-1", None), ("-1", "+2", "a-b"), ("a", "b", None), (None, "b\\", "\\+"), ("-", "-", "-")]:
        name = (hmm.context_name(left) + "-" if left else "") + hmm.context_name(centre) + ("+" + hmm.context_name(right) if right else "")
        assert hmm.context_parts(name) == (left, centre, right)
