"""Hash trees against the flat comparison."""

import hashlib
import random

import pytest

from attestry.sources import files, trees


def stored(flat, objects):
    """The id of the tree of {path: (mode, blob)}; its objects go to objects."""
    here, below = {}, {}
    for path, e in flat.items():
        head, _, rest = path.partition("/")
        if rest:
            below.setdefault(head, {})[rest] = e
        else:
            here[head] = e
    for name, part in below.items():
        here[name] = (trees.TREE, stored(part, objects))
    tid = hashlib.sha1(repr(sorted(here.items())).encode()).hexdigest()
    objects[tid] = [(tid, n, m, b) for n, (m, b) in here.items()]
    return tid


def edited(r, flat, times):
    out = dict(flat)
    for _ in range(times):
        kind, path = r.random(), r.choice(sorted(out) or ["x"])
        if kind < 0.3:
            out.pop(path, None)
        elif kind < 0.6:
            out[path] = (r.choice([0o100644, 0o100755, 0o120000]), f"b{r.randrange(99)}")
        elif kind < 0.8 and "/" in path:  # a directory becomes a file
            top = path.rpartition("/")[0]
            out = {p: e for p, e in out.items() if not p.startswith(top + "/")} | {top: (0o100644, "was a directory")}
        else:
            head = path.split("/")[0]
            if head not in out:
                out[f"{head}/new/n{r.randrange(9)}"] = (0o100644, f"b{r.randrange(99)}")
    return {p: e for p, e in out.items() if not any(q != p and p.startswith(q + "/") for q in out)}


@pytest.mark.parametrize("n_parents", [0, 1, 2, 3])
def test_equal_to_the_flat_comparison(spark, n_parents):
    r = random.Random(n_parents)
    base = {f"d{a}/e{b}/f{c}": (0o100644, f"b{a}{b}{c}") for a in range(4) for b in range(3) for c in range(3)} | {"top": (0o100755, "t"), "d0/x": (0o100644, "x")}
    for times in (0, 6):
        tree, parents = edited(r, base, times), [edited(r, base, r.choice([0, times])) for _ in range(n_parents)]
        objects, ids = {}, []
        top = stored(tree, objects)
        for p in parents:
            ids.append(stored(p, objects))
        rows = lambda flat: [(p, m, b) for p, (m, b) in flat.items()]
        flat = spark.createDataFrame(rows(tree), "path string, mode int, blob_id string")
        other = spark.createDataFrame([(f"p{k}", *x) for k, p in enumerate(parents) for x in rows(p)], "parent string, path string, mode int, blob_id string")
        want = sorted(map(tuple, files.changed_files(flat, other).select("path", "mode", "blob_id", "status").collect()))
        table = spark.createDataFrame([x for o in objects.values() for x in o], "tree_id string, name string, mode int, object_id string")
        assert sorted(map(tuple, trees.changed_in_trees(table, top, ids).collect())) == want


def test_unchanged_subtrees_are_not_read(spark):
    """Objects of equal subtrees may be missing; depth counts, not width."""
    base = {f"d{a}/e{b}/f": (0o100644, f"b{a}{b}") for a in range(30) for b in range(30)}
    objects, before = {}, {}
    top = stored(base | {"d7/e3/f": (0o100644, "changed")}, objects)
    parent = stored(base, before)
    shared = (set(objects) & set(before)) - {top, parent}
    left = [x for o in (objects, before) for k, v in o.items() if k not in shared for x in v]
    table = spark.createDataFrame(left, "tree_id string, name string, mode int, object_id string")
    assert len(shared) > 800 and [tuple(x) for x in trees.changed_in_trees(table, top, [parent]).collect()] == [("d7/e3/f", 0o100644, "changed", "modified")]
    assert trees.changed_in_trees(table, top, [top]).count() == 0 and trees.changed_in_trees(table, None, []).count() == 0
