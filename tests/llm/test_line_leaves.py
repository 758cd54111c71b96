import pyarrow as pa

from seqloom.llm import line_dedup as L


def parsed(lines, size):
    rows = sorted((len(x.split()), x.split()[: L.DEPTH], x, k) for k, x in enumerate(lines))
    table = pa.table({"path": pa.array([0] * len(rows), pa.int64()), "key": pa.array([r[3] for r in rows], pa.int64()), "line": [r[2] for r in rows], "docs": pa.array([1] * len(rows), pa.int64())})
    return {r["key"]: r["template"] for b in L._parse(iter(table.to_batches(size))) for r in b.to_pylist()}


def test_a_leaf_is_made_with_its_second_line(monkeypatch):
    """Before, each line of a leaf of its own made a table, an array of rows and an index of blocks."""
    made, leaf = [], L.Leaf
    monkeypatch.setattr(L, "Leaf", lambda n: made.append(n) or leaf(n))
    lines = [f"line{k} stands alone under its own path" for k in "abcdefgh"] + ["two words"]
    same = ["one two three four five six seven eight", "one two three four five six seven nine", "one two three red blue green pink grey"]
    for size in (100, 1):
        made.clear()
        got = parsed(lines + same, size)
        assert all(got[k] == k for k in range(len(lines)))
        assert got[9] == got[10] and got[11] == 11
        assert made == [8]
