import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lociflow.operators import shred


def brute(payload):
    """Objects by plain recursion over json.loads: (parent_path, node_path)."""
    out = []

    def walk(v, path, owner, top):
        if isinstance(v, str) and v.strip(" \t\n\r")[:1] in ("{", "["):
            try:
                inner = json.loads(v)
            except ValueError:
                inner = v
            if isinstance(inner, dict | list):
                v = inner
        if isinstance(v, dict):
            if not top:
                out.append((owner, path))
            for k, x in v.items():
                walk(x, f"{path}/{k}" if path else k, path, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}" if path else str(i), owner, False)

    try:
        walk(json.loads(payload), "", "", True)
    except ValueError:
        return []
    return out


def mine(payload):
    found = shred.nodes(payload)
    path = {n[0]: n[7] for n in found}
    return [(path.get(n[2], ""), n[7]) for n in found if n[5] == "o" and n[0] != 0]


scalars = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=3), x, max_size=3) | x.map(json.dumps), max_leaves=12)


@given(values)
@settings(max_examples=400, deadline=None)
def test_objects_match_plain_recursion(value):
    text = json.dumps(value)
    assert sorted(set(mine(text))) == sorted(set(brute(text)))


def test_incomplete_and_odd_payloads():
    for bad in (None, "", " ", '{"a": 1', '{"a": {}} x', "{'a': 1}", "[1,]", "01", "NaN", '{"a" 1}', '"\x01"'):
        assert shred.nodes(bad) == []
    assert mine('{"a": {}, "b": [{"c": {}}]}') == [("", "a"), ("", "b/0"), ("b/0", "b/0/c")]
    assert mine('{"a": " {\\"b\\": {}} "}') == [("", "a"), ("a", "a/b")]
    deep = "[" * 5000 + "{}" + "]" * 5000
    assert len(shred.nodes(deep)) == 5001


def test_tables(spark):
    rows = [(1, '{"cases": [{"checks": [{"name": "x", "expected": 1}, {"name": "y", "expected": {"z": 2}}]}]}', "k"), (2, '{"cases": {"checks": {"name": "w"}}}', "k"), (3, None, "k"), (None, "{", None)]
    df = spark.createDataFrame(rows + rows[:1], "receipt_id long, payload string, node string")
    adj = shred.adjacency(df, "receipt_id", "payload")
    got = {(r.receipt_id, r.name, r.expected) for r in shred.entity_table(adj, "receipt_id", "cases/checks", ["name", "expected"]).collect()}
    assert got == {(1, "x", "1"), (1, "y", None), (2, "w", None)}
    links = {tuple(r) for r in shred.object_links(df, "receipt_id", "payload").collect()}
    assert (1, "cases/0", "cases/0/checks/1") in links and (1, "cases/0/checks/1", "cases/0/checks/1/expected") in links
    assert (2, "cases", "cases/checks") in links and len(links) == 6
    assert shred.object_links(df.limit(0), "receipt_id", "payload").count() == 0


def test_every_object_has_a_row(spark, tmp_path):
    from lociflow.plans import catalog

    texts = [
        {"cases": [{"name": "c", "checks": [{"name": "x", "passed": True, "observed": {"folio": "f1", "counts": {"kept": 2}}}, {"name": "y", "observed": [3, "q", None]}]}]},
        {"checks": {"source_pinned": True, "source_structure": [{"target": "t", "expected": 4, "by_book": {"1": 9}}]}, "freeze": {"files": [{"path": "p", "Path": "q", "sha256": "s"}]}},
        {"tracks": {"QX": {"regions": {"sun": {"loci": ["a", "b"], "candidates": [{"token": "o", "at": {"line": 1}}]}}}}, "sources": {"source": "s", "tracks": {"L": "A", "pivots": [{"col": 2, "rows": [1]}]}}},
        {"manual_review": {"batches": [{"name": "b", "feature_status_counts": {"choice": {"PASS": 1}}}, {}]}, "earlier_failures": [{"steps": [{"name": "z"}]}]},
        [{"cases": {"name": "bare"}}],
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows + rows[:2], "receipt_id long, payload string").write.parquet(f"{tmp_path}/receipts.parquet")
    tables = {n: [r.asDict() for r in catalog.QUERIES[f"p6_{n}"](spark, str(tmp_path)).collect()] for n in [*catalog.ENTITIES, "children", "list_values"]}
    values = tables.pop("list_values")
    want = [(i, n[7], n[8]) for i, t in rows for n in shred.nodes(t) if n[5] == "o"]
    assert sorted((r["receipt_id"], r["path"], r["entity"]) for t in tables.values() for r in t) == sorted(want)
    paths = {n: sorted(r["path"] for r in t) for n, t in tables.items()}
    assert paths["checks"] == ["cases/0/checks/0", "cases/0/checks/1", "checks", "checks/source_structure/0"]
    assert paths["tracks"] == ["sources/tracks", "tracks", "tracks/QX"] and paths["regions"] == ["tracks/QX/regions", "tracks/QX/regions/sun"]
    assert paths["cases"] == ["0/cases", "cases/0"] and paths["sources"] == ["sources"] and paths["batches"] == ["manual_review/batches/0", "manual_review/batches/1"]
    checks = {r["path"]: r for r in tables["checks"]}
    assert (checks["cases/0/checks/0"]["name"], checks["cases/0/checks/0"]["passed"], checks["cases/0/checks/0"]["observed"]) == ("x", "true", None)
    assert checks["checks"]["source_pinned"] == "true" and (checks["checks/source_structure/0"]["target"], checks["checks/source_structure/0"]["expected"]) == ("t", "4")
    children = {r["path"]: r for r in tables["children"]}
    assert children["cases/0/checks/0/observed"]["folio"] == "f1" and children["sources/tracks/pivots/0"]["col"] == "2" and children["earlier_failures/0/steps/0"]["name"] == "z"
    assert {children["freeze/files/0"][k] for k in ("path_2", "Path_2", "path_3", "Path_3") if k in children["freeze/files/0"]} == {"p", "q"}
    assert sorted((r["receipt_id"], r["path"], r["scalar"]) for r in values) == sorted(
        [(0, "cases/0/checks/1/observed/0", "3"), (0, "cases/0/checks/1/observed/1", "q"), (0, "cases/0/checks/1/observed/2", None), (2, "tracks/QX/regions/sun/loci/0", "a"), (2, "tracks/QX/regions/sun/loci/1", "b"), (2, "sources/tracks/pivots/0/rows/0", "1")]
    )
