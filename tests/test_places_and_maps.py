"""Innermost declarations against every declaration, and three maps of a working folder against plain dictionaries."""

import random

from tidemark.operators import enclosing, working


def nested(rng, path, first, last, owner, depth, out):
    """Random declarations that nest, some of them on the same lines."""
    at = first
    while at <= last and rng.random() < 0.9:
        start = at + rng.choice([0, 1, 5, 90])
        end = min(last, start + rng.choice([0, 3, 40, 700, 1500]))
        if start > last:
            return
        name = f"{owner}.d{len(out)}" if owner else f"d{len(out)}"
        out.append((path, name, start, end))
        if depth < 6 and end > start:
            nested(rng, path, start + rng.choice([0, 1]), end, name, depth + 1, out)
        at = end + 1


def test_innermost_declarations_equal_brute_force_with_one_hot_file(spark):
    rng, declared = random.Random(3), []
    for path, lines in (("hot.py", 9000), ("a.py", 900), ("b.py", 40)):
        nested(rng, path, 1, lines, "", 0, declared)
    seen = [(rng.choice(["hot.py", "hot.py", "a.py", "b.py", "none.py"]), rng.randint(1, 9000), rng.choice(["f", "x.d3", "d7"])) for _ in range(3000)] + [(p, s, n.split(".")[-1]) for p, n, s, _ in declared]
    d = spark.createDataFrame(declared, "path string, name string, start_line long, end_line long")
    o = spark.createDataFrame(seen, "path string, line long, function string")
    found = sorted((r.path, r.line, r.function, r.enclosing or "", r.qualified) for r in enclosing.enclosing(o, d).collect())
    expected = []
    for path, line, function in seen:
        around = [(s, -e, len(n), n) for p, n, s, e in declared if p == path and s <= line <= e]
        here = [(-e, len(n), n) for p, n, s, e in declared if p == path and s == line]
        at = max(here)[-1] if here else None
        expected.append((path, line, function, max(around)[-1] if around else "", at if at and at.split(".")[-1] == function.split(".")[-1] else function))
    # equal ranges have no order of their own: one of them is named
    ranges = {(p, n): (s, e) for p, n, s, e in declared}
    twice = {(p, s) for p, n, s, e in declared if sum(1 for q, m, t, f in declared if (q, t, f) == (p, s, e)) > 1}
    for got, want in zip(found, sorted(expected)):
        assert got[:3] == want[:3] and ranges.get((got[0], got[3])) == ranges.get((want[0], want[3]))
        assert got[4] == want[4] or (got[0], got[1]) in twice
    assert sum(e != "" for *_, e, _ in found) > 1000


def test_a_working_folder_is_dirty_where_any_map_differs(spark):
    base = [(s, p, "100644", f"o{p}") for s in range(7) for p in ("a.py", "b.py")]
    expected = [*base, (5, "vendor/x.py", "100644", "v")]
    captured = [r for r in base if r[:2] != (1, "a.py")] + [(2, "new.py", "100644", "n")]
    captured = [(s, p, "100755" if (s, p) == (3, "b.py") else m, o) for s, p, m, o in captured]
    index = [(s, p, m, "other" if (s, p) == (4, "a.py") else o, 0) for s, p, m, o in base]
    index = [(*r[:4], 1) if r[:2] == (6, "a.py") else r for r in index] + [(6, "a.py", "100644", "theirs", 3)]
    frame = lambda rows, more="": spark.createDataFrame(rows, "snapshot long, path string, mode string, oid string" + more)
    rows = working.working_status(frame(captured), frame(expected), frame(index, ", stage int")).collect()
    assert {r.snapshot: (r.dirty, r.index_known, r.changed_paths, r.staged_paths, r.unmerged_paths) for r in rows} == {
        0: (False, True, 0, 0, 0), 1: (True, True, 1, 0, 0), 2: (True, True, 1, 0, 0), 3: (True, True, 1, 0, 0), 4: (True, True, 0, 1, 0), 5: (False, True, 0, 0, 0), 6: (True, False, 0, 0, 1),
    }
