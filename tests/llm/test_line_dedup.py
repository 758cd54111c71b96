import random
import re
from collections import defaultdict

from seqloom.llm import line_dedup as L


def brute(rows):
    """Templates by trying every earlier first line of a leaf, and the texts without recurring lines."""
    docs = defaultdict(set)

    def mask(line):
        return " ".join(L.FIELD.decode() if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))

    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(mask(line).split()) >= L.WORDS:
                docs[mask(line)].add(i)
    firsts, template = defaultdict(list), {}
    for line in sorted(docs, key=lambda x: x.encode()):
        w = line.split()
        leaf = firsts[len(w), *w[: L.DEPTH]]
        fit = [(-sum(a == b for a, b in zip(w, f, strict=True)), k) for k, f in enumerate(leaf)]
        fit = [x for x in fit if -x[0] >= len(w) * L.SIMILAR]
        if fit:
            template[line] = tuple(leaf[min(fit)[1]])
        else:
            leaf.append(w)
            template[line] = tuple(w)
    spread = defaultdict(set)
    for line, t in template.items():
        spread[t] |= docs[line]
    out = {}
    for i, t in rows:
        def gone(line):
            t = template.get(mask(line))
            return t is not None and len(spread[t]) >= L.DOCUMENTS and i != min(x for x in spread[t] if x is not None)

        lines = (t or "").split("\n")
        stay = [x for x in lines if not gone(x)]
        out[i, t] = (None if t is None else "\n".join(stay), 0 if t is None else len(lines), len(lines) - len(stay))
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("red blue green pink grey teal".split())
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, "user 7 logged in from host ten today"), (3, "one two three four\n" * 4)]
    for k in range(4, 60):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(4)]
        lines.append(f"user {k} logged in from host {word()} today")
        if k % 3 == 0:
            lines.append("  a passage that  many documents share, word for word, with no change\t")
        if k in (10, 11):
            lines.append("only two documents have this line of words")
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows += [rows[20], (70, "x y z " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    want = brute(rows)
    got = L.drop_recurring(df)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    found = sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())))
    assert found == sorted(map(str, ((i, *want[i, t]) for i, t in rows)))
    assert sum(v[2] for v in want.values()) > 60
    assert L.drop_recurring(df.limit(0)).count() == 0
