"""Spelling variants, Merkle manifests and near vectors against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thawline.llm import merkle, neardup, spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
UP_TO_LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least_length=7, least_n=2, ratio=10):
    n = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UP_TO_LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: m for w, m in n.items() if len(w) >= least_length and m >= least_n}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n[form[w]] if form[w] is not None else None)
    return out


def as_dict(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_spelling_variants(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.choice((6, 7, 8, 11)))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "zzzzzzzz", "Ärgernisse", "ÿÿÿÿÿÿÿ×÷"]
    words = []
    for s in stems:
        words += [s] * rng.choice((2, 30, 300))
        for _ in range(6):
            i = rng.randrange(len(s) + 1)
            words += [s[:i] + rng.choice(("", "a", "b", "É")) + s[i + rng.choice((0, 1)) :]] * rng.choice((1, 2, 3, 25))
    long = "".join(rng.choice("xy") for _ in range(20_000))
    words += [long, long, long[:9_000] + long[9_001:], long[:9_000] + long[9_001:], long[:15_000] + "q" + long[15_001:]] * 2 + ["tiny"] * 50
    words += ["chainaaa"] * 900 + ["chainaab"] * 60 + ["chainabb"] * 4  # a form of a form
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(-(-len(words) // 40))]
    rows += [(900, None), (901, ""), (902, "123 -- \n"), (None, "aaaaaaa AAAAAAAA aaaaaaab9aaaaaaab"), (3, "Repeated repeated"), (3, "Repeated repeated")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    found, expect = as_dict(spelling.variants(docs)), brute_variants(rows)
    assert found == expect and sum(v[0] is not None for v in expect.values()) > 10 and long in found and any(v[0] and v[1] != v[0] for v in expect.values())
    assert spelling.variants(docs.limit(0)).count() == 0


def test_tries_number_each_prefix_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    for parts in (1, 3, 40):
        nodes = {}
        rows = spelling.trie_nodes(spark.createDataFrame([(w, 1) for w in words], "w string, n int"), "w", parts).collect()
        for r in rows:
            for i, x in enumerate(r["nodes"]):
                assert nodes.setdefault(x, r["w"][:i]) == r["w"][:i]
        assert len(nodes) == len({w[:i] for w in words for i in range(len(w) + 1)})
        assert [r["w"] for r in sorted(rows, key=lambda r: r["rank"])] == words


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, arity):
    """Root, and the siblings of each leaf level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // arity * arity : p // arity * arity + arity]
            paths[i].append((run[: p % arity], run[p % arity + 1 :]))
        level = [h(*level[a : a + arity]) for a in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], paths


@pytest.mark.parametrize("arity", [2, 8])
def test_merkle_manifest(spark, arity):
    rng = random.Random(arity)
    sizes = {None: 9, "": 1, "de": 17, "en": 150, "fr": 64, "é": 65, "zz": 2} | {f"l{i}": 1 for i in range(20)}
    rows = []
    for lang, m in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice((None, "a:b", "-")), lang, rng.choice((None, 5)), rng.choice((None, "", "Text É", "x" * 70_000, f"t{rng.random()}"))) for _ in range(m)]
    rows += [(None, "a", "en", 1, "no id"), rows[40], rows[40], (rows[40][0], "other", rows[40][2], None, "same id")]
    docs = spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(7)
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf([F.upper(c) if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(docs, arity=arity, changed=changed).withColumn("folded", merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    found = sorted((r["doc_id"] or -1, r["lang"] or "", r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"]), r["folded"]) for r in found.collect())

    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: h(*map(value, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: brute_tree([leaf(r) for r in groups[g]], arity) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order], arity)
    expect = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            first = leaf(r) if r[0] is None or r[0] % 3 else leaf((*r[:4], r[4] and r[4].upper()))
            folded = first
            for before, after in [*path, *top]:
                folded = h(*before, folded, *after)
            expect.append((r[0] or -1, r[2] or "", leaf(r), trees[g][0], root, tuple(("".join(a), "".join(b)) for a, b in [*path, *top]), folded))
    assert found == sorted(expect) and 0 < sum(x[-1] != root for x in found) < len(found)


def test_merkle_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] == h("1:1", "1:s", "2:en", "1:2", "2:ab") and r["path"] == []
    assert merkle.manifest(docs.limit(0)).count() == 0


def brute_near(rows, least):
    links = {i: set() for i in range(len(rows))}
    usable = [x is not None and None not in x and np.isfinite(x).all() and any(x) and lab is not None for _, x, lab in rows]
    for i, (_, x, lab) in enumerate(rows):
        for j in range(i):
            if usable[i] and usable[j] and lab == rows[j][2] and len(x) == len(rows[j][1]):
                a, b = np.array(x, float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    group = list(range(len(rows)))
    while True:
        new = [min([group[i], *[group[j] for j in links[i]]]) for i in range(len(rows))]
        if new == group:
            break
        group = new
    first = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            first[g] = min(first.get(g, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(links[i]), first.get(g), rows[i][0] == first.get(g)) for i, g in enumerate(group))


@pytest.mark.parametrize(("cell", "block"), [(10**6, 10**6), (30, 10**6), (20, 16)])
def test_near_duplicates(spark, cell, block):
    rng = np.random.RandomState(3)
    rows, vec_id = [], 0
    for lab, m in ((1, 60), (2, 150), (3, 4), (None, 5)):
        base = rng.randn(m, 6)
        for x in base:
            for y in (x, *[x + rng.randn(6) * rng.choice((0.02, 0.2, 0.5)) for _ in range(rng.choice((0, 0, 1, 4)))]):
                vec_id += 1
                rows.append((vec_id * 37 % 4999, [float(np.float32(v)) for v in y], lab))
    rows += [(5000 + i, [float(np.float32(v)) for v in base[0] * 2], 2) for i in range(40)]
    rows += [(6000, None, 1), (6001, [0.0] * 6, 1), (6002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (6003, [float("nan")] * 6, 1), (6004, [float("inf")] + [0.0] * 5, 1), (6005, [], 1)]
    rows += [(6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1), rows[3], rows[3], (rows[3][0], rows[50][1], 1), (None, rows[3][1], rows[3][2]), (None, [9.0], 7)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int, v int").repartition(6)
    found = neardup.near_duplicates(frame, cell=cell, block=block)
    assert Counter(tuple(r) for r in found.collect()) == brute_near(rows, 0.98)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_cells_are_used(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([c + rng.randn(100, 8) * 0.05 for c in np.eye(8)[:5] * 3])
    frame = spark.createDataFrame([(1, 8, [float(a) for a in v], i, 1) for i, v in enumerate(x)], "label int, dim int, v array<double>, node long, m long")
    centres = neardup.fit_cells(frame, 100, 1024, 32)
    assert len(centres[1, 8]) == 5
    placed = neardup.members(frame, centres, 0.98).toPandas()
    assert placed.home.sum() == 500 == len(placed) and placed.cell.value_counts().tolist() == [100] * 5
