"""Walks, packings and orders over file graphs against plain versions."""

from __future__ import annotations

import random

from gleanline.operators import graph, skills


def made(seed, n=30):
    rng = random.Random(seed)
    names = [f"f{k:02d}" for k in range(n)]
    edges = {tuple(sorted(rng.sample(names, 2))): rng.choice([0.3, 0.5, 1.0, 1.5]) for _ in range(2 * n)}
    return names, {f: rng.randrange(5, 60) for f in names}, edges


def near(edges, f):
    return {(set(e) - {f}).pop(): w for e, w in edges.items() if f in e}


def plain_split(names, size, edges, budget):
    degree = {f: sum(near(edges, f).values()) for f in names}
    seen, order = [], []
    while len(order) < len(names):
        queue = [max((f for f in names if f not in seen), key=lambda f: (degree[f], [-ord(c) for c in f]))]
        seen.append(queue[0])
        while queue:
            f = queue.pop(0)
            order.append(f)
            for n in sorted((n for n in near(edges, f) if n not in seen), key=lambda n: (-near(edges, f)[n], n)):
                seen.append(n)
                queue.append(n)
    pieces, now = [], []
    for f in order:
        if size[f] > budget:
            pieces += [p for p in (now, [f]) if p]
            now = []
        else:
            if now and sum(size[x] for x in now) + size[f] > budget:
                pieces.append(now)
                now = []
            now.append(f)
    return [p for p in [*pieces, now] if p]


def plain_pack(names, size, edges, budget):
    bins = []
    for f in sorted(names, key=lambda f: (-size[f], f)):
        room = [k for k, b in enumerate(bins) if sum(size[x] for x in b) + size[f] <= budget]
        pull = {k: sum(w for n, w in near(edges, f).items() if n in bins[k]) for k in room}
        if room:
            bins[max(room, key=lambda k: (pull[k], -k))].append(f)
        else:
            bins.append([f])
    return bins


def test_splits_and_packs(spark):
    for seed in (1, 2):
        names, size, edges = made(seed)
        members = spark.createDataFrame([("g", f, size[f]) for f in names] + [("small", "one", 900)], "group string, file string, size long")
        links = spark.createDataFrame([("g", a, b, w) for (a, b), w in edges.items()], "group string, a string, b string, weight double")
        got = {}
        for r in graph.split_components(members, links, 120).collect():
            got.setdefault((r.group, r.piece), set()).add(r.file)
        want = plain_split(names, size, edges, 120)
        assert [got["g", k] for k in range(len(want))] == [set(p) for p in want] and got["small", 0] == {"one"}
        packed = {}
        items = members.filter("group = 'g'").selectExpr("group", "file AS item", "size AS tokens")
        for r in graph.pack_items(items, links, 120).collect():
            packed.setdefault(r.bin, set()).add(r.item)
        assert [packed[k] for k in range(len(packed))] == [set(b) for b in plain_pack(names, size, edges, 120)]


def test_files_come_behind_what_they_import(spark):
    rng = random.Random(4)
    names = [f"f{k:02d}" for k in range(20)]
    imports = {(names[a], names[b]) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(40)) if a != b}
    tests = {f: f in ("f03", "f11") for f in names}
    want, state = [], set()

    def visit(f):
        if f not in state:
            state.add(f)
            for d in sorted(b for a, b in imports if a == f):
                visit(d)
            want.append(f)

    for f in sorted(names, key=lambda f: (tests[f], f)):
        visit(f)
    files = spark.createDataFrame([("g", f, tests[f]) for f in names], "group string, file string, is_test boolean")
    links = spark.createDataFrame([("g", a, b) for a, b in imports], "group string, a string, b string")
    got = sorted(graph.order_files(files, links).collect(), key=lambda r: r.place)
    assert [r.file for r in got] == want


def test_large_groups_are_chains(spark):
    files = spark.createDataFrame([("big", f"b{k:03d}") for k in range(50)] + [("small", f"s{k}") for k in range(4)], "g string, file string")
    edges = graph.collect_edges(graph.group_edges(files, ["g"], 0.3, "directory")).collect()
    assert sum(e.a.startswith("s") for e in edges) == 6 and {(e.a, e.b) for e in edges if e.a.startswith("b")} == {(f"b{k:03d}", f"b{k + 1:03d}") for k in range(49)}


def test_extended_skills_come_in_while_there_is_room(spark):
    known = [skills.Skill("a", 9, 40, extends=("p",)), skills.Skill("b", 8, 50), skills.Skill("c", 7, 30), skills.Skill("p", 1, 20, extends=("q",)), skills.Skill("q", 1, 20)]
    rows = spark.createDataFrame([(1, "a", 9), (1, "b", 8), (1, "c", 7), (2, "b", 8)], "chunk long, skill string, score long")
    got = {(r.chunk, r.skill, r.via) for r in skills.select(rows, known, 100).collect()}
    assert got == {(1, "a", "match"), (1, "b", "match"), (2, "b", "match")}
    got = {(r.chunk, r.skill, r.via) for r in skills.select(rows, known, 115).collect()}
    assert got == {(1, "a", "match"), (1, "b", "match"), (1, "p", "extends:a"), (2, "b", "match")}


def test_smart_groups_keep_what_belongs_together(spark):
    import random

    rng = random.Random(8)
    files = {f"r{r}/f{k:02d}": (r, rng.choice([5, 20, 40, 130]), rng.random() < 0.2) for r in range(3) for k in range(40)}
    names = sorted(files)
    edges, imports = [], []
    for r in range(3):
        own = [f for f in names if files[f][0] == r]
        for _ in range(60):
            a, b = rng.sample(own, 2)
            edges.append((a, b, rng.choice([0.1, 0.3, 0.6, 1.0]), rng.choice(["import", "call", "directory"])))
            imports += [(a, b)] * (edges[-1][3] == "import")
    found = graph.smart_groups(spark.createDataFrame([(r, f, n, t) for f, (r, n, t) in files.items()], "run int, file string, tokens int, is_test boolean"), spark.createDataFrame(edges, "a string, b string, weight double, reason string"), spark.createDataFrame(imports, "a string, b string"), 120).collect()
    assert sorted(r.file for r in found) == names and all(files[r.file][0] == r.run for r in found)
    chunks = {}
    for r in found:
        chunks.setdefault((r.run, r.chunk), []).append((r.place, r.file))
    where = {f: c for c, rows in chunks.items() for _, f in rows}
    for rows in chunks.values():
        assert sorted(p for p, _ in rows) == list(range(len(rows)))
        assert sum(files[f][1] for _, f in rows) <= 120 or len(rows) == 1
    for run in range(3):
        firsts = [min(f for _, f in chunks[c]) for c in sorted(c for c in chunks if c[0] == run)]
        assert firsts == sorted(firsts) and [c[1] for c in sorted(c for c in chunks if c[0] == run)] == list(range(len(firsts)))
    # components of strong affinities by a plain union, those within the budget in one chunk
    weight, group = {}, {f: f for f in names}
    for a, b, w, reason in edges:
        key = (min(a, b), max(a, b), reason)
        weight[key] = max(weight.get(key, 0), w)
    total = {}
    for (a, b, _), w in weight.items():
        total[a, b] = total.get((a, b), 0) + w
    changed = True
    while changed:
        changed = False
        for (a, b), w in total.items():
            if w >= graph.STRONG and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    for g in set(group.values()):
        members = [f for f in names if group[f] == g]
        if sum(files[f][1] for f in members) <= 120:
            assert len({where[f] for f in members}) == 1
    # within a chunk a file stands behind what it imports, unless both import each other by some way
    reach = {f: {b for a, b in imports if a == f} for f in names}
    for _ in range(6):
        reach = {f: r | set().union(*(reach[x] for x in r)) if r else r for f, r in reach.items()}
    place = {f: p for rows in chunks.values() for p, f in rows}
    inside = [(a, b) for a, b in imports if where[a] == where[b] and a not in reach[b]]
    assert inside and all(place[b] < place[a] for a, b in inside)


def test_a_name_of_many_files_makes_no_pairs(spark):
    rows = lambda n, name: spark.range(n).selectExpr(f"'{name}' AS name", "id AS file")
    declaring, calling = rows(5000, "hot").unionByName(rows(2, "rare")), rows(5000, "hot").unionByName(rows(3, "rare"))
    assert {tuple(r) for r in graph.call_pairs(declaring, calling).collect()} == {(a, b) for a in range(3) for b in range(2) if a != b}


def test_call_links_meets_only_the_names_that_link(spark, tmp_path):
    from gleanline.plans import graphs

    # one name that 20,000 files declare and call (400,000,000 pairs), and one that links file 1 with file 3
    hot = spark.range(40000).selectExpr("3000L AS l_partkey", "id + 10 AS l_orderkey", "cast(1 + id % 2 AS int) AS l_linenumber")
    hot.union(spark.createDataFrame([(7, 3, 1), (7, 1, 2)], hot.schema)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in graphs.call_links(spark, str(tmp_path)).collect()] == [(1, 3)]


def test_a_large_group_is_ordered_and_packed_in_time(spark):
    import time

    n = 40000
    files = spark.range(n).selectExpr("'g' AS group", "format_string('f%06d', id) AS file", "id % 7 = 0 AS is_test")
    imports = spark.range(n - 1).selectExpr("'g' AS group", "format_string('f%06d', id) AS a", "format_string('f%06d', id + 1) AS b")
    start = time.monotonic()
    placed = {r.file: r.place for r in graph.order_files(files, imports).collect()}
    assert placed["f000001"] > placed["f000002"] and sorted(placed.values()) == list(range(n))
    items = files.selectExpr("group", "file AS item", "500L + cast(substr(file, 2) AS long) % 100 AS tokens")
    packed = graph.pack_items(items, imports.withColumn("weight", imports.a.substr(2, 6).cast("double") * 0 + 1), 900).collect()
    assert len({r.bin for r in packed}) == n
    assert time.monotonic() - start < 60


def test_enclosing_declarations_of_a_long_file(spark):
    rng, lines = random.Random(3), []
    for at in range(1, 400):
        lines.append(("a", at, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, f"n{at}"]), rng.random() < 0.5))
    kind = "file string, at long, indent int, name string, wanted boolean"
    want = set()
    for _, at, indent, _, wanted in lines:
        over = [(a, n) for _, a, i, n, _ in lines if at - 20 <= a <= at and n and i is not None and (indent is None or i <= indent)]
        want |= {("a", at, over[-1][1], over[-1][0])} if wanted and over else set()
    assert {tuple(r) for r in graph.enclosing(spark.createDataFrame(lines, kind), ["file"], 20).collect()} == want
    # 100,000 declarations, all of them wanted: comparing each with each would be 10,000,000,000 steps
    many = spark.range(1, 100001).selectExpr("'b' AS file", "id AS at", "cast(id % 7 AS int) AS indent", "concat('n', id) AS name", "true AS wanted")
    assert graph.enclosing(many, ["file"]).count() == 100000


def test_what_holds_everywhere_meets_the_files_where_they_are(spark):
    from gleanline.operators import stack

    files = spark.createDataFrame([("a/b/x.ts",), ("a/y.ts",), ("z.ts",)], "file string")
    techs = spark.createDataFrame([(".", 1), ("a", 2), ("a/b", 3), ("z.ts", 4), (".", 9)], "dir string, tech int")
    found = stack.techs_of_files(files, techs, spark.createDataFrame([(9,), (8,)], "tech int"))
    assert {tuple(r) for r in found.collect()} == {(f, t) for f in ("a/b/x.ts", "a/y.ts", "z.ts") for t in (1, 8, 9)} | {("a/b/x.ts", 2), ("a/b/x.ts", 3), ("a/y.ts", 2), ("z.ts", 4)}
    assert "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_cochange_counts_pairs_out_of_each_commit(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice(["a", "b", "c", "d", "e", None])) for c in range(40) for _ in range(rng.randrange(1, 6))] + [(None, "a"), (None, "b")] + [(99, f"x{k}") for k in range(7)]
    commits = {c: {i for k, i in rows if k == c} for c, _ in rows if c is not None}
    commits = {c: s for c, s in commits.items() if len(s) <= 4}  # a commit of too many items counts nowhere
    revs = {i: sum(i in s for s in commits.values()) for i in "abcde"}
    n = {(a, b): sum(a in s and b in s for s in commits.values()) for a in revs for b in revs if a < b}
    out = graph.cochange(spark.createDataFrame(rows, "c int, i string"), "c", "i", 4, 1, 0.0, tasks=3)
    assert {(r.a, r.b): (r.n, r.coupling) for r in out.collect()} == {p: (k, k / min(revs[x] for x in p)) for p, k in n.items() if k}
    # pairs are made within a commit's list, not by a join of all rows with themselves: only the two counts are joined
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_packing_does_not_hold_a_review(spark, monkeypatch):
    import tracemalloc

    from gleanline.operators import greedy

    kept = greedy.followed

    def measured(rows, keys, order, schema, follow):
        def peak(group):
            tracemalloc.start()
            n = sum(1 for _ in follow(group))
            yield "g", str(n), tracemalloc.get_traced_memory()[1]

        return kept(rows, keys, order, schema, peak)

    monkeypatch.setattr(greedy, "followed", measured)
    n = 60000
    items = spark.range(n).selectExpr("'g' AS group", "format_string('some/path/f%06d', id) AS item", "20 + id % 90 AS tokens")
    links = spark.range(n - 3).selectExpr("'g' AS group", "id", "explode(array(1, 2, 3)) AS k").selectExpr("group", "format_string('some/path/f%06d', id) AS a", "format_string('some/path/f%06d', id + k) AS b", "0.5D AS weight")
    (seen,) = graph.pack_items(items, links, 900).collect()
    # a list of the rows with both directions' links takes some 100 MB
    assert seen.item == str(n) and seen.bin < 25e6


def test_commits_of_several_columns_and_repeated_items(spark):
    rows = [(1, "a", x) for x in (3, 1, 2, 1, None)] + [(1, "b", x) for x in (1, 2)] + [(None, "a", x) for x in (1, 2)] + [(None, None, x) for x in (1, 2)] + [(2, "a", x) for x in range(31)] + [(2, "b", 1)]
    found = graph.cochange(spark.createDataFrame(rows, "c long, d string, i long"), ["c", "d"], "i", min_count=1, min_coupling=0.0).collect()
    assert {(r.a, r.b, r.n, r.coupling) for r in found} == {(1, 2, 3, 1.0), (1, 3, 1, 1.0), (2, 3, 1, 1.0)}
