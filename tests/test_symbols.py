"""Declarations, the index of names, changed symbols and their impact on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanline.operators import symbols
from gleanline.sources import code

DECLARES = [
    ("function load(a, b) {", "load"), ("export async function save() {", "save"), ("  def run(self):", "run"), ("pub fn next_id(&self) -> u32 {", "next_id"), ("func (s *Store) Put(k string) error {", "Put"), ("class MYLIB_API Widget {", "Widget"), ("struct Point", "Point"), ("export const draw = (x) => {", "draw"),
    ("  refresh(token) {", "refresh"), ("static int hash_of(const char *p, int n)", "hash_of"), ("public void close() throws E {", "close"), ("interface Shape {", "Shape"), ("let handle: Fn = async function () {", "handle"),
    ("  return load(a);", None), ("load(a, b);", None), ("if (a) {", None), ("await save() {", None), ("x = y + 1", None), ("else if (load(a)) {", None), ("function if(", None), ("", None), ("function " + "x" * 400, None),
]
FILES = "repo string, file string, content string"


def test_declared_names(spark):
    rows = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(DECLARES)], "k int, line string").select("k", symbols.declared_name(F.col("line")).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: n for k, (_, n) in enumerate(DECLARES)}


@pytest.mark.parametrize(("line", "names"), [("len(append(make(x)))", ["len", "append", "make"]), ("yield (a); try (b); const (c); until (d); interface (e)", []), ("a(b(cde(f)))", ["cde"]), ("unlessx(1) $el(2)", ["unlessx", "$el"])])
def test_calls(spark, line, names):
    assert spark.range(1).select(code.calls(F.array(F.lit(line)))).first()[0] == names


def test_index_places_and_common_names(spark):
    files = [("r", f"f{k}.ts", "shared()\n" + ("alpha alpha\n\nfunction alpha(beta) {\nimport beta\n" if k == 0 else "beta\n" * (k == 1))) for k in range(25)] + [("s", "g.ts", "alpha"), ("s", "n.ts", None)]
    index = symbols.postings(spark.createDataFrame(files, FILES))
    assert {tuple(r.gaps) for r in index.filter("repo = 'r' AND name = 'alpha'").collect()} == {(2, 2)}
    found = {(r.repo, r.name, r.file, r.at, r.kind) for r in symbols.search(index, index.select("repo", "name")).collect()}
    assert found == {("r", "import", "f0.ts", 5, 2), ("r", "alpha", "f0.ts", 2, 0), ("r", "alpha", "f0.ts", 4, 1), ("r", "beta", "f0.ts", 4, 0), ("r", "beta", "f0.ts", 5, 2), ("r", "beta", "f1.ts", 2, 0), ("s", "alpha", "g.ts", 1, 0)}


def test_changed_symbols(spark):
    now = "\n".join(["function kept(a, b) {", "  work();", "  more();", "}", "", "function other() {", "  body2();", "}"])
    changes = [(3, "del", 1, "function kept(a) {"), (4, "add", 1, "function kept(a, b) {"), (6, "add", 3, "  more();"), (10, "del", 5, "function gone() {"), (11, "del", 5, "}"), (14, "add", 7, "  body2();"), (15, "del", 8, "static tiny() {"), (20, "del", 99, "function ab() {")]
    frame = spark.createDataFrame([("r", "a.c", *x) for x in changes], "repo string, file string, pos int, kind string, at int, text string")
    found = {(r.name, r.kind, r.local) for r in symbols.changed_symbols(frame, spark.createDataFrame([("r", "a.c", now)], FILES)).collect()}
    assert found == {("kept", "signature", False), ("gone", "removed", False), ("other", "body", False), ("tiny", "removed", True)}


def test_impact(spark):
    files = [("r", "lib/store.ts", "function put(x) {\n}\nfunction drop(x) {\n}"), ("r", "lib/near.ts", "function caller() {\n  put(1)\n}\nput(2)"), ("r", "app/far.ts", "import put from '../lib/store'\nfunction deep() {\n  if (a) {\n    put(3)"), ("r", "app/namesake.ts", "put(4)"), ("r", "vendor/v.ts", "store put"), ("r", "app/changed.ts", "store put"), ("q", "lib/near.ts", "put(5)")]
    rows = spark.createDataFrame(files, FILES)
    changed = spark.createDataFrame([("r", "lib/store.ts"), ("r", "app/changed.ts")], "repo string, file string")
    names = spark.createDataFrame([("r", "lib/store.ts", "put", "signature", False), ("r", "lib/store.ts", "drop", "removed", False), ("r", "lib/store.ts", "nobody", "body", False), ("r", "lib/store.ts", "mine", "removed", True)], "repo string, file string, name string, kind string, local boolean")
    found = {r.name: ([(s.path, s.at, s.inside) for s in r.sites], r.more) for r in symbols.impact(names, rows, symbols.postings(rows), changed).collect()}
    assert found == {"put": ([("lib/near.ts", 2, "caller"), ("lib/near.ts", 4, "caller"), ("app/far.ts", 4, "deep")], 0), "drop": ([], 0)}
    short = symbols.impact(names, rows, symbols.postings(rows), changed, listed=1).filter("name = 'put'").first()
    assert len(short.sites) == 1 and short.more == 1


def test_names_are_not_shuffled(spark):
    index = symbols.postings(spark.createDataFrame([("r", "a.ts", "alpha alpha beta\nalpha")], FILES))
    assert {(r.name, tuple(r.gaps), tuple(r.kinds)) for r in index.collect()} == {("alpha", (1, 1), (0, 0)), ("beta", (1,), (0,))}
    exchanges = [x for x in index._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert exchanges and all("name#" not in x for x in exchanges)


def test_impact_needs_no_lines_of_names_that_tell_nothing(spark):
    shared = "common()\n"
    files = [("r", "lib/store.ts", "function put(x) {\n}\nfunction common(x) {\n}"), ("r", "lib/near.ts", f"{shared}function put(y) {{\n  put(1)\nimport put\nput {'x' * 400}"), ("r", "app/far.ts", f"store\n{shared}  put(2) put(3)"), ("r", "app/other.ts", f"{shared}put(4)"), ("r", "app/long.ts", f"put(5)\nstore {'x' * 400}")]
    rows = spark.createDataFrame(files + [("r", f"lib/f{k}.ts", shared) for k in range(25)], FILES)
    changed = spark.createDataFrame([("r", "lib/store.ts")], "repo string, file string")
    of_change = symbols.definitions(rows.join(changed, ["repo", "file"], "left_semi")).selectExpr("repo", "file", "name", "'signature' AS kind", "false AS local")
    index = symbols.names(rows)
    assert index.columns == ["repo", "name", "file"] and index.count() == symbols.postings(rows).count()
    found = {r.name: ([(s.path, s.at, s.inside) for s in r.sites], r.more) for r in symbols.impact(of_change, rows, index, changed).collect()}
    assert found == {"put": ([("lib/near.ts", 3, "put"), ("app/far.ts", 3, None)], 0)}


def test_code_files_are_the_words_four_a_line(spark, tmp_path):
    from gleanline.plans.names import code_files

    texts = {0: None, 1: "", 2: "a bc 12", **{k: " ".join(f"w{'abcdefghij'[j % 10] * (j % 5 + 2)}" for j in range(k)) for k in [*range(3, 11), 19, 20, 21, 38, 40, 61]}}
    spark.createDataFrame([(k, t, f"s{k}", k) for k, t in texts.items()], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in texts.items():
        words = [w for w in (text or "").split() if len(w) >= 3 and w.isalpha()]
        fours = [words[i : i + 4] for i in range(0, len(words), 4)]
        lines = [f"function {x[0]}({', '.join(x[1:])}) {{" if i % 5 == 0 else f"  {x[0]}({', '.join(x[1:])});" for i, x in enumerate(fours)]
        want[f"s{k}"] = (f"d{k % 4}/{next((w for w in words if len(w) >= 6), 'file')}.ts", "\n".join(lines), k)
    assert {r.repo: (r.file, r.content, r.n_chars) for r in code_files(spark, str(tmp_path)).collect()} == want
