"""Affinity graphs: co-change coupling and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared checkpoint folder and read from there."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cochange(changes: DataFrame, commit: str | list[str], item: str, max_items: int = 30, min_count: int = 2, min_coupling: float = 0.3, tasks: int | None = None) -> DataFrame:
    """(a, b, n, coupling, weight): pairs of items that commits of at most max_items items change together.

    Coupling is the pair's count over the smaller of the items' counts. The bound on a commit's size is
    the operator's rule and keeps the pairs of a commit at most max_items squared. tasks: how many tasks
    commits are dealt to (null: as the session has it); each counts its own pairs before they meet.
    """
    named = [commit] if isinstance(commit, str) else commit
    keys = [f"c{k}" for k in range(len(named))]
    rows = changes.select(*(F.col(c).alias(k) for c, k in zip(named, keys, strict=True)), F.col(item).alias("i")).filter(" OR ".join(f"{k} IS NOT NULL" for k in keys))
    rows = rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
    # rows are sorted once: equal ones stand side by side, items are counted before any is listed, and each meets the later ones of its commit
    of_commit = Window.partitionBy(*keys)
    sorted_ = of_commit.orderBy("i")
    first = (F.row_number().over(sorted_) == 1) | ~F.lag("i").over(sorted_).eqNullSafe(F.col("i"))
    small = rows.withColumn("first", first).filter("first").withColumn("n", F.count(F.lit(1)).over(of_commit)).filter(F.col("n") <= max_items)
    revs = small.groupBy("i").agg(F.count(F.lit(1)).alias("revs"))
    later = small.withColumn("later", F.collect_list("i").over(sorted_.rowsBetween(1, max_items))).filter("i IS NOT NULL")
    pairs = later.select(F.col("i").alias("a"), F.explode("later").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    both = pairs.join(revs.select(F.col("i").alias("a"), F.col("revs").alias("ra")), "a").join(revs.select(F.col("i").alias("b"), F.col("revs").alias("rb")), "b")
    out = both.withColumn("coupling", F.col("n") / F.least("ra", "rb")).filter(F.col("coupling") >= min_coupling)
    return out.select("a", "b", "n", "coupling", (0.5 * F.least(F.lit(1.0), F.col("coupling"))).alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex reachable from each vertex of edges (a, b).

    Each round takes the least label of the neighbours, sends it to the old label as well and takes that
    label's own label; it is cut. The rounds end when nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "v").select("v", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        sent = spread.select(F.explode(F.array(F.struct("v", "old", "component"), F.struct(F.col("old").alias("v"), F.lit(None).cast(labels.schema["v"].dataType).alias("old"), "component"))).alias("s")).select("s.*")
        hooked = sent.groupBy("v").agg(F.max("old").alias("old"), F.min("component").alias("component"))
        jump = hooked.select(F.col("v").alias("_v"), F.col("component").alias("_next"))
        new = cut(hooked.join(jump, F.col("component") == F.col("_v"), "left").select("v", "old", F.least("component", "_next").alias("component")))
        labels = new.select("v", "component")
        if new.filter("old != component").isEmpty():
            return labels


#: Files of a group up to which each is linked with each; larger groups are linked as a chain.
CLIQUE = 40
#: Files that declare a name, and that call it, up to which the name links them; least weight that holds files together.
MAX_DECLARING, MAX_CALLERS, STRONG = 3, 8, 0.5


def group_edges(files: DataFrame, group: list[str], weight: float, reason: str) -> DataFrame:
    """(a, b, weight, reason): links within groups of files: all pairs of a small group, neighbours by name in a large one."""
    from pyspark.sql import Window

    rows = files.select(*group, "file").distinct()
    by = Window.partitionBy(*group)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_before", F.lag("file").over(by.orderBy("file")))
    small = rows.filter(F.col("_n") <= CLIQUE).select(*group, "file")
    pairs = small.withColumnRenamed("file", "a").join(small.withColumnRenamed("file", "b"), group).filter("a < b").select("a", "b")
    chain = rows.filter((F.col("_n") > CLIQUE) & F.col("_before").isNotNull()).select(F.col("_before").alias("a"), F.col("file").alias("b"))
    return pairs.unionByName(chain).withColumn("weight", F.lit(weight)).withColumn("reason", F.lit(reason))


def collect_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of files and reason, the strongest, its ends in order."""
    rows = edges.filter("a <> b AND weight > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "reason")
    return rows.groupBy("a", "b", "reason").agg(F.max("weight").alias("weight"))


def call_pairs(declaring: DataFrame, calling: DataFrame) -> DataFrame:
    """(a, b): a file that calls a name and one that declares it; at most MAX_CALLERS times MAX_DECLARING a name."""
    # counted first, so that the files of a name that tells nothing are neither made distinct nor sorted where the name's files meet
    few = lambda rows, most: rows.groupBy("name").agg(F.count_distinct(F.struct("file")).alias("_n")).filter(F.col("_n") <= most).select("name")
    by_name = lambda rows, most: rows.join(few(rows, most), "name", "left_semi").distinct()
    known = by_name(calling, MAX_CALLERS).join(declaring.select("name").distinct(), "name", "left_semi")
    pairs = known.select("name", F.col("file").alias("a")).join(by_name(declaring, MAX_DECLARING).select("name", F.col("file").alias("b")), "name").filter("a <> b")
    return pairs.select("a", "b").distinct()


def call_edges(declaring: DataFrame, calling: DataFrame, refers: DataFrame) -> DataFrame:
    """(a, b, weight, reason): a file that calls a name with the files that declare it and that it refers to.

    declaring, calling: name, file; refers: a (the caller), b. Names that too many files declare or call tell nothing.
    """
    linked = call_pairs(declaring, calling).join(refers.select("a", "b").distinct(), ["a", "b"], "left_semi")
    return linked.select("a", "b", F.lit(1.0).alias("weight"), F.lit("call").alias("reason"))


def affinity(edges: DataFrame) -> DataFrame:
    """(a, b, weight, strongest): the sum of a pair's weights over its reasons, and the reason that weighs most."""
    return collect_edges(edges).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max(F.struct("weight", "reason"))["reason"].alias("strongest"))


# How tests are named after what they test, by family of languages.
FAMILIES = {"js": "js jsx mjs cjs ts tsx mts cts vue svelte", "python": "py", "go": "go", "java": "java kt kts scala", "ruby": "rb", "rust": "rs", "php": "php", "csharp": "cs", "elixir": "ex exs"}
TEST_NAMES = {"js": r"^(.+)[._-](?:test|spec)$", "python": r"^(?:test_(.+)|(.+)_test)$", "go": r"^(.+)_test$", "java": r"^(?:(.+?)(?:Tests?|Spec|IT)|Test(.+))$", "ruby": r"^(.+)_(?:spec|test)$", "rust": r"^(.+)_test$", "php": r"^(.+)Test$", "csharp": r"^(.+?)Tests?$", "elixir": r"^(.+)_test$"}
TEST_DIRS, NEUTRAL = ["test", "tests", "__tests__", "spec", "specs"], ["src", "lib", "app", "main", "java", "kotlin", "test", "tests", "__tests__", "spec", "specs", "unit", "integration"]


def pair_tests(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, test, source): tests with the sources of their name in the likeliest directory, or with the only one of that name anywhere.

    Directories are as likely as 3 (the same one, or a test directory within it) or 2 (the same but for neutral parts).
    """
    from pyspark.sql import Window

    extension = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    family = F.coalesce(*(F.when(extension.isin(*e.split()), F.lit(f)) for f, e in FAMILIES.items()))
    directory = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    rows = files.select(*keys, "file", family.alias("family"), directory.alias("dir"), F.regexp_extract("file", r"([^/]+?)\.[^./]+$", 1).alias("stem")).filter("family IS NOT NULL").distinct()
    named = F.coalesce(*(F.when((F.col("family") == f) & F.col("stem").rlike(p), F.concat_ws("", *(F.coalesce(F.regexp_extract("stem", p, k), F.lit("")) for k in range(1, 1 + (2 if p.count("(.+") > 1 else 1))))) for f, p in TEST_NAMES.items()))
    in_dir = F.arrays_overlap(F.split("dir", "/", -1), F.array(*map(F.lit, TEST_DIRS))) & ~F.col("family").isin("go", "python")
    rows = rows.withColumn("subject", F.coalesce(named, F.when(in_dir, F.col("stem"))))
    plain = F.array_join(F.filter(F.split("dir", "/", -1), lambda s: ~s.isin(".", *NEUTRAL)), "/")
    rows = rows.withColumn("plain", plain).withColumn("above", F.when(F.regexp_extract("dir", r"([^/]+)$", 1).isin(*TEST_DIRS), F.when(F.contains("dir", F.lit("/")), F.regexp_replace("dir", "/[^/]*$", "")).otherwise(".")))
    tests = rows.filter("subject IS NOT NULL").select(*keys, "family", F.col("subject").alias("stem"), F.col("file").alias("test"), F.col("dir").alias("t_dir"), F.col("plain").alias("t_plain"), "above")
    sources = rows.filter("subject IS NULL").select(*keys, "family", "stem", F.col("file").alias("source"), "dir", "plain")
    score = F.when((F.col("t_dir") == F.col("dir")) | (F.col("above") == F.col("dir")), 3).when(F.col("t_plain") == F.col("plain"), 2).otherwise(0)
    met = tests.join(sources, [*keys, "family", "stem"]).withColumn("score", score)
    of_test = Window.partitionBy(*keys, "test")
    met = met.withColumn("best", F.max("score").over(of_test)).withColumn("n", F.count(F.lit(1)).over(of_test))
    sure = F.col("best") >= F.when(F.col("family") == "go", 3).otherwise(2)
    return met.filter((sure & (F.col("score") == F.col("best"))) | (~sure & (F.col("n") == 1) & (F.col("family") != "go"))).select(*keys, "test", "source")


def linked_rows(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """rows (group, key) with `links`: an array of each one's neighbours and weights in edges (group, a, b, weight), both ways, null without any."""
    both = edges.select("group", F.col("a").alias(key), F.struct(F.col("b").alias("to"), "weight").alias("l")).unionByName(edges.select("group", F.col("b").alias(key), F.struct(F.col("a").alias("to"), "weight").alias("l")))
    return rows.join(both.groupBy("group", key).agg(F.array_sort(F.collect_list("l")).alias("links")), ["group", key], "left")


def split_components(members: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """members (group, file, size) with `piece`: groups beyond the budget are walked breadth first along the strongest edges and cut where a piece is full.

    edges: group, a, b, weight within groups. The walk depends on itself, so a task holds one group, which is one chunk's component.
    """
    from math import fsum

    from gleanline.operators.greedy import decided

    def decide(rows: list) -> list[tuple]:
        group, size = rows[0].group, {r.file: r.size for r in rows}
        if len(rows) == 1 or sum(size.values()) <= budget:
            return [(group, r.file, 0) for r in rows]
        near: dict = {}
        for r in rows:
            mine = near[r.file] = {}
            for link in r.links or ():
                if link["to"] in size:
                    mine[link["to"]] = mine.get(link["to"], 0) + link["weight"]
        seen, order = set(), []
        for seed in sorted(size, key=lambda f: (-fsum(near[f].values()), f)):
            if seed in seen:
                continue
            queue, head = [seed], 0
            seen.add(seed)
            while head < len(queue):
                here, head = queue[head], head + 1
                order.append(here)
                for n, _ in sorted(near[here].items(), key=lambda x: (-x[1], x[0])):
                    if n not in seen:
                        seen.add(n)
                        queue.append(n)
        piece, used, out = 0, 0, []
        for f in order:
            alone = size[f] > budget
            if used and (alone or used + size[f] > budget):
                piece, used = piece + 1, 0
            out.append((group, f, piece))
            used += size[f]
            if alone:
                piece, used = piece + 1, 0
        return out

    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    return decided(linked_rows(members.select("group", "file", "size"), "file", edges), ["group"], ["file"], f"group {kinds['group']}, file {kinds['file']}, piece long", decide)


def pack_items(items: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """items (group, item, tokens) with `bin`: the largest first, each into the open bin with room that it has the strongest links with, else the first with room.

    edges: group, a, b, weight above 0. Each choice depends on the earlier ones, so a task reads one group (one review)
    from the largest item on. Items are numbered in that order, and each comes with its links to earlier ones alone:
    what is held of an item is its bin, and of a bin the room. The first bin with room is found in a tree over the
    rooms, not by looking at each.
    """
    from array import array

    from gleanline.operators.greedy import followed

    def follow(rows):
        # leaves from `wide` on are the bins' rooms, each node above holds its larger child; bins that are not open yet stand behind the open ones
        wide, opened, where = 1, 0, array("q")
        room = array("q", [budget, budget])
        for r in rows:
            n, pull = r.tokens, {}
            for at, weight in zip(r.near or (), r.weights or (), strict=True):
                pull[where[at]] = pull.get(where[at], 0) + weight
            best = max((k for k in pull if room[wide + k] >= n), key=lambda k: (pull[k], -k), default=None)
            if best is None and n > budget:
                best = opened
            elif best is None:
                k = 1
                while k < wide:
                    k = 2 * k if room[2 * k] >= n else 2 * k + 1
                best = k - wide
            opened = max(opened, best + 1)
            k = wide + best
            room[k] -= n
            while k > 1:
                k //= 2
                room[k] = max(room[2 * k], room[2 * k + 1])
            if opened == wide:
                room = array("q", [budget]) * (2 * wide) + room[wide:] + array("q", [budget]) * wide
                wide *= 2
                for k in range(wide - 1, 0, -1):
                    room[k] = max(room[2 * k], room[2 * k + 1])
            where.append(best)
            yield r.group, r.item, best

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    numbered = cut(items.select("group", "item", "tokens", (F.row_number().over(Window.partitionBy("group").orderBy(F.desc("tokens"), "item")) - 1).alias("at")))
    of_item = lambda end: numbered.select("group", F.col("item").alias(end), F.col("at").alias(f"_{end}"))
    met = edges.select("group", "a", "b", "weight").join(of_item("a"), ["group", "a"]).join(of_item("b"), ["group", "b"]).filter("_a <> _b")
    # the links of an item are summed in order of the others' names
    link = F.struct(F.when(F.col("_a") < F.col("_b"), F.col("a")).otherwise(F.col("b")).alias("to"), F.least("_a", "_b").alias("at"), "weight")
    links = met.groupBy("group", F.greatest("_a", "_b").alias("at")).agg(F.array_sort(F.collect_list(link)).alias("l")).select("group", "at", F.col("l.at").alias("near"), F.col("l.weight").alias("weights"))
    return followed(numbered.join(links, ["group", "at"], "left"), ["group"], ["at"], f"group {kinds['group']}, item {kinds['item']}, bin long", follow)


def order_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (group, file, is_test) with `place`: each behind what it imports within its group, sources before tests, else by name; cycles break where they are first met."""
    from gleanline.operators.greedy import decided

    def decide(rows: list) -> list[tuple]:
        known = {r.file for r in rows}
        wants = {r.file: sorted(d for d in r.wants or () if d in known and d != r.file) for r in rows}
        seen, out = set(), []
        for root in (r.file for r in rows):
            stack = [(root, iter(wants[root]))] if root not in seen else []
            seen.add(root)
            while stack:
                here, rest = stack[-1]
                step = next((d for d in rest if d not in seen), None)
                if step is None:
                    out.append((rows[0].group, here, len(out)))
                    stack.pop()
                else:
                    seen.add(step)
                    stack.append((step, iter(wants[step])))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    wants = imports.groupBy("group", F.col("a").alias("file")).agg(F.collect_set("b").alias("wants"))
    return decided(files.select("group", "file", "is_test").join(wants, ["group", "file"], "left"), ["group"], ["is_test", "file"], f"group {kinds['group']}, file {kinds['file']}, place long", decide)


def split_chunks(parts: DataFrame, chunk: str) -> DataFrame:
    """parts (chunk, at, file, tokens) with `half`, 1 or 2: cut at the file boundary nearest the middle, within a file only if there is no other; chunks of one part are left out."""
    from pyspark.sql import Window

    by = Window.partitionBy(chunk)
    rows = parts.withColumn("_acc", F.sum("tokens").over(by.orderBy("at"))).withColumn("_total", F.sum("tokens").over(by)).withColumn("_next", F.lead("file").over(by.orderBy("at"))).withColumn("_last", F.max("at").over(by))
    gap = F.abs(F.col("_total") - 2 * F.col("_acc")) + F.when(F.col("_next") != F.col("file"), 0).otherwise(2 * F.col("_total"))
    cut_at = F.min(F.when(F.col("at") < F.col("_last"), F.struct(gap.alias("g"), F.col("at").alias("at")))).over(by)["at"]
    rows = rows.withColumn("_cut", cut_at).filter("_cut IS NOT NULL")
    return rows.withColumn("half", F.when(F.col("at") <= F.col("_cut"), 1).otherwise(2)).drop("_acc", "_total", "_next", "_last", "_cut")


def enclosing(lines: DataFrame, keys: list[str], back: int = 300) -> DataFrame:
    """(keys, at, name, decl_at): the nearest declaration at or above each wanted line of a file that is not indented deeper.

    lines: keys, at, indent (null: a blank line), name (what the line declares, or null), wanted. A file's
    declarations and wanted lines are read in order, with the open declarations on a stack of rising indents:
    one that a later line of no deeper indent declares over is never the nearest again.
    """
    from bisect import bisect_right
    from itertools import groupby

    from gleanline.operators.greedy import decided

    def decide(rows: list) -> list[tuple]:
        held, indents, out = [], [], []
        for at, same in ((at, list(g)) for at, g in groupby(rows, key=lambda r: r.at)):
            for r in same:
                if r.name is not None and r.indent is not None:
                    while indents and indents[-1] >= r.indent:
                        held.pop(), indents.pop()
                    held.append(r)
                    indents.append(r.indent)
            for r in same:
                k = len(held) if r.indent is None else bisect_right(indents, r.indent)
                if r.wanted and k and held[k - 1].at >= at - back:
                    out.append((*r[: len(keys)], at, held[k - 1].name, held[k - 1].at))
        return out

    rows = lines.select(*keys, "at", "indent", "name", "wanted").filter("wanted OR (name IS NOT NULL AND indent IS NOT NULL)")
    fields = [rows.schema[c] for c in (*keys, "at", "name")]
    return decided(rows, keys, ["at", "indent", "name"], StructType([*fields, StructField("decl_at", rows.schema["at"].dataType)]), decide)


def smart_groups(files: DataFrame, edges: DataFrame, imports: DataFrame, budget: int) -> DataFrame:
    """(run, chunk, file, place): a review's files in chunks of at most `budget` tokens that keep together what belongs together.

    Files that strong affinities connect are a component; one beyond the budget is cut along its strongest links;
    pieces are packed by the links between them, and each chunk's files are ordered behind what they import.
    Chunks count from 0 by their first path. A file beyond the budget is a chunk of its own.

    files: run, file (unique over all runs), tokens, is_test; edges: a, b, weight, reason, all kinds at once;
    imports: a, b. A step that depends on its own choices sees one component, or one review's pieces, or one chunk.
    """
    from pyspark.sql import Window

    near = cut(affinity(edges).select("a", "b", "weight"))
    of = components(near.filter(F.col("weight") >= STRONG)).withColumnRenamed("v", "file")
    members = cut(files.join(of, "file", "left").select("run", "file", "tokens", "is_test", F.coalesce("component", "file").alias("group")))
    # components within the budget are one piece, so only the files and edges of larger ones are walked
    large = members.groupBy("group").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n")).filter((F.col("_t") > budget) & (F.col("_n") > 1)).select("group")
    walked = cut(members.join(large, "group", "left_semi").select("group", "file", F.col("tokens").cast("long").alias("size")))
    of_walked = lambda end: walked.select(F.col("file").alias(end), F.col("group").alias(f"_{end}"))
    inside = near.join(of_walked("a"), "a").join(of_walked("b"), "b").filter("_a = _b").select(F.col("_a").alias("group"), "a", "b", "weight")
    pieces = split_components(walked, inside, budget)
    # a piece is named by its first file, as a component is
    named = pieces.withColumn("item", F.min("file").over(Window.partitionBy("group", "piece"))).select("file", "item")
    members = cut(members.join(named, "file", "left").withColumn("item", F.coalesce("item", "group")).drop("group"))
    items = members.groupBy(F.col("run").alias("group"), "item").agg(F.sum("tokens").cast("long").alias("tokens"))
    of_item = lambda end: members.select(F.col("file").alias(end), F.col("item").alias(f"_{end}"), F.col("run").alias(f"_r{end}"))
    between = near.join(of_item("a"), "a").join(of_item("b"), "b").filter("_ra = _rb AND _a <> _b").groupBy(F.col("_ra").alias("group"), F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight"))
    binned = cut(members.join(pack_items(items, between, budget).withColumnRenamed("group", "run"), ["run", "item"]))
    first = binned.groupBy("run", "bin").agg(F.min("file").alias("_f"))
    numbered = first.select("run", "bin", (F.row_number().over(Window.partitionBy("run").orderBy("_f")) - 1).alias("chunk"), F.col("_f").alias("group"))
    members = cut(binned.join(numbered, ["run", "bin"]).select("run", "chunk", "group", "file", "is_test"))
    own = imports.select("a", "b").distinct().join(members.select(F.col("file").alias("a"), "group"), "a").join(members.select(F.col("file").alias("b"), F.col("group").alias("_g")), "b").filter("group = _g").select("group", "a", "b")
    placed = order_files(members.select("group", "file", "is_test"), own)
    return members.join(placed.select("file", "place"), "file").select("run", "chunk", "file", "place")
