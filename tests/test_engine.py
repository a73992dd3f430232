"""Stores, refreshes, streams, search, budgets, logs and the command line."""

from __future__ import annotations

import glob
import io
import json
import os
import shutil
import sqlite3
import subprocess
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkindex.functions import hashing, paths, text
from sparkindex.model import Index
from sparkindex.operators import budget, evaluation, lookups, scan, search
from sparkindex.operators.snapshot import TABLES, drift, snapshot
from sparkindex.plans import benchmarking, facade, indexing
from sparkindex.plans.store import Store
from sparkindex.sources import records, tree
from sparkindex.streaming import watch

FILES = {
    "app.py": "from lib.core import save_all as keep\n\n\nclass Repo:\n    def save(self):\n        keep(1)\n\n\ndef main():\n    Repo().save()\n",
    "lib/core.py": "def save_all(x):\n    return x\n\n\ndef process(x):\n    return save_all(x)\n",
    "web/ui.tsx": 'import { load } from "./api";\nexport const Page = () => <Card x={load()} />;\n',
    "web/api.ts": "export function load() { return fetch(1); }\n",
    "notes.txt": "def no(): pass\n",
}


def put(root, files):
    for path, source in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(source)


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "tree", FILES)
    return str(tmp_path / "tree")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def values(index: Index):
    return {name: sorted(map(repr, (tuple(r) for r in rows.collect()))) for name, rows in snapshot(index).items()}


def test_build_and_lookups(spark, root, store):
    built = indexing.build(spark, root, store, 10.0)
    assert (built.indexed, built.skipped_large, built.failed, built.removed) == (4, 0, 0, 0)
    index = store.read()
    assert lookups.stats(index).first().asDict() == {"files": 4, "symbols": 9, "refs": 7}
    assert [(r.path, r.start_line) for r in lookups.find_definition(index, "Repo.save").collect()] == [("app.py", 5)]
    uses = lookups.find_references(index, "save_all").collect()
    assert [(r.path, r.line, r.confidence) for r in uses] == [("app.py", 6, "import"), ("lib/core.py", 6, "exact")]
    assert [r.qualified_name for r in lookups.outline_file(index, "app.py").collect()] == ["keep", "Repo", "Repo.save", "main"]
    top = lookups.repo_map(index).first()
    assert (top.path, top.incoming_refs, top.top_symbols) == ("lib/core.py", 1, ["save_all", "process"])
    assert lookups.index_age_ms(index, 12.5).first()[0] == 2500
    assert lookups.index_age_ms(store.empty(), 12.5).first()[0] == 0
    assert lookups.repo_map(store.empty()).count() == 0


def test_stored_lookups_reach_the_scans(spark, root, store, capsys):
    """A lookup of one thing filters the stored tables where they are read, with the same rows."""
    indexing.build(spark, root, store, 1.0)
    index = store.read()
    for name in ("save_all", "Repo.save", "fetch", "load", "keep", "nothing"):
        few = lookups.narrowed(index, name)
        assert lookups.find_references(few, name).collect() == lookups.find_references(index, name).collect()
        assert few.refs.count() <= index.refs.count()
    assert lookups.narrowed(index, "fetch").refs.count() == 1 and lookups.narrowed(index, "nothing").refs.count() == 0

    def pushed(rows):
        capsys.readouterr()
        rows.explain("formatted")
        return [line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters")]

    assert any("EqualTo(name,save)" in line and "EqualTo(qualified_name,save)" in line for line in pushed(lookups.find_definition(index, "save")))
    assert any("EqualTo(file_id," in line for line in pushed(lookups.outline_file(index, "app.py")))
    assert any("EqualTo(resolved_symbol_id," in line or "In(resolved_symbol_id" in line for line in pushed(lookups.narrowed(index, "save_all").refs))
    folder = f"{store.root}/{store.manifest(store.versions()[-1])['folder']}"
    for path in glob.glob(f"{folder}/symbols/*.parquet"):
        names = pq.read_table(path).column("name").to_pylist()
        assert names == sorted(names)


def test_refresh_outcomes(spark, root, store):
    indexing.build(spark, root, store, 1.0)
    first = store.versions()
    asked = spark.createDataFrame([("app.py",), ("nope.py",)], "path string")
    assert {r.path: r.outcome for r in indexing.refresh(spark, root, store, asked, 2.0).collect()} == {"app.py": "unchanged", "nope.py": "absent"}
    assert store.versions() == first
    os.remove(f"{root}/lib/core.py")
    put(root, {"web/api.ts": "export function load() { return 1; }\nexport function load2() {}\n", "big.py": "x = 1\n" * 300_000})
    asked = spark.createDataFrame([("lib/core.py",), ("web/api.ts",), ("big.py",), ("notes.txt",)], "path string")
    assert {r.path: r.outcome for r in indexing.refresh(spark, root, store, asked, 2.0).collect()} == {"lib/core.py": "removed", "web/api.ts": "updated", "big.py": "absent", "notes.txt": "absent"}
    assert indexing.check(spark, root, store).count() == 0
    store.prune(1)
    assert len(store.versions()) == 1 and lookups.stats(store.read()).first().files == 3


def test_interrupted_writer_leaves_no_trace(spark, root, store):
    indexing.build(spark, root, store, 1.0)
    before = values(store.read())
    store.stage(spark.range(3))
    os.makedirs(f"{store.root}/v000000000002-dead/files")
    assert values(store.read()) == before
    indexing.build(spark, root, store, 1.0)
    assert values(store.read()) == before and not os.listdir(f"{store.root}/staging")


NAMES = ["a.py", "b.py", "pkg/a.py", "web/x.ts", "web/y.tsx", "k.js", "t.txt", "node_modules/z.js"]
CONTENTS = ["", "def f():\n    g()\n", "from pkg.a import f\nf()\n", "class f(g:\n", "export function g() { return f(); }\n", 'import { g } from "./x";\ng();\n', "é = 'ü'\n\n\ndef größe(): f()\n", "def f(): pass\ndef f(): pass\n"]
OPERATIONS = st.lists(st.tuples(st.sampled_from(["write", "delete", "rename"]), st.integers(0, 7), st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=8)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(OPERATIONS)
def test_refreshed_equals_rebuilt(spark, tmp_path, operations):
    """After any edits, a sweep and single refreshes both give what a rebuild gives."""
    base = str(tmp_path / "work")
    shutil.rmtree(base, ignore_errors=True)
    root = f"{base}/tree"
    put(root, {"a.py": CONTENTS[1], "web/x.ts": CONTENTS[4]})
    stores = [Store(spark, f"{base}/{name}") for name in ("single", "swept", "cold")]
    for one in stores[:2]:
        indexing.build(spark, root, one, 1.0)
    touched = set()
    for kind, path, content, target in operations:
        name, other = NAMES[path], NAMES[target]
        touched |= {name, other}
        if kind == "write":
            put(root, {name: CONTENTS[content]})
        elif os.path.exists(f"{root}/{name}"):
            if kind == "delete":
                os.remove(f"{root}/{name}")
            else:
                os.makedirs(os.path.dirname(f"{root}/{other}"), exist_ok=True)
                os.replace(f"{root}/{name}", f"{root}/{other}")
    indexing.refresh(spark, root, stores[0], spark.createDataFrame([(t,) for t in touched], "path string"), 2.0)
    indexing.sweep(spark, root, stores[1], 2.0)
    indexing.build(spark, root, stores[2], 2.0)
    expected = values(stores[2].read())
    assert values(stores[0].read()) == expected and values(stores[1].read()) == expected
    assert drift(stores[2].read(), stores[0].read()).isEmpty() and set(expected) == set(TABLES)


def test_stream_keeps_index_fresh(spark, root, store, tmp_path):
    indexing.build(spark, root, store, 1.0)
    put(root, {"new.py": "def fresh(): main()\n"})
    os.makedirs(tmp_path / "events")
    for k in range(20):
        (tmp_path / "events" / f"{k}.json").write_text(json.dumps({"path": "new.py", "ts": "2024-01-01T00:00:00", "op": "modified"}))
    query = watch.watch(spark, root, store, watch.read_events(spark, str(tmp_path / "events")), str(tmp_path / "ck"), once=True)
    query.awaitTermination()
    assert lookups.find_definition(store.read(), "fresh").count() == 1
    assert len(store.versions()) == 2  # twenty events, one refresh
    assert indexing.check(spark, root, store).isEmpty()


def test_discovery(tmp_path, root):
    put(root, {"dist/a.py": "", "x/__init__.py": "", "x/.hidden.py": "", "y/build": "", "z/deep/node_modules/q.js": ""})
    walked = sorted(tree.listed(root))
    assert walked == ["app.py", "lib/core.py", "web/api.ts", "web/ui.tsx", "x/.hidden.py", "x/__init__.py"]
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    assert sorted(tree.listed(root)) == walked
    put(root, {".gitignore": "lib/\n"})
    assert sorted(tree.listed(root)) == [p for p in walked if not p.startswith("lib/")]
    assert tree.is_ignored(root, "lib/core.py") and not tree.is_ignored(root, "app.py") and tree.is_ignored(root, "dist/a.py")


def test_path_expressions(spark):
    cases = ["a/b/../c", "./a//b/.", "../x", "a/../..", "", "a/b/../../.."]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "p string").select(paths.normalized(F.col("p"))).collect()]
    assert got == ["a/c", "a/b", "../x", "..", ".", ".."]


def test_like_is_ascii_and_unescaped(spark):
    rows = spark.createDataFrame([("GRÜN",), ("grün",), ("a_b",), ("axb",), ("50%",)], "t string")

    def hits(pattern):
        return [r.t for r in rows.where(text.like(F.col("t"), pattern)).collect()]

    assert hits("gr%n") == ["GRÜN", "grün"] and hits("grü%") == ["grün"] and hits("A_B") == ["a_b", "axb"] and hits("a\\_b") == ["a_b"]
    assert hits(text.escaped_like("50%")) == ["50%"] and hits("x\\y") == []


def test_hashes(spark):
    assert hashing.content_hash(b"") == "cae66941d9efbd404e4d88758ea67670"
    frame = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary").select(hashing.blake2b("b").alias("h"))
    assert [r.h for r in frame.collect()] == [hashing.content_hash(b"abc"), None]


def symbols_index(spark, rows):
    files = spark.createDataFrame([(1, "f.py", "python", "", 1.0, 1.0)], "file_id long, path string, language string, content_hash string, mtime double, indexed_at double")
    symbols = spark.createDataFrame([(k, 1, k, n, q, "function", k, k, s, None) for k, (n, q, s) in enumerate(rows)], "symbol_id long, file_id long, ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, signature string, parent_id long")
    refs = spark.createDataFrame([], "file_id long, name string, line int, resolved_symbol_id long, confidence string")
    return Index(files, symbols, refs)


def test_token_search_agrees_with_sqlite(spark):
    """Matches and scores of a full-text table with the same rules."""
    words = ["save_all", "saveAll", "process_all", "grüßen", "Grusen", "all", "process", "x1", "save all things", "naïve_Process"]
    rows = [(words[k % 10], f"Mod{k % 3}.{words[k % 10]}", None if k % 4 == 0 else f"def {words[(k * 7) % 10]}(self, all)") for k in range(23)]
    index = symbols_index(spark, rows)
    base = sqlite3.connect(":memory:")
    try:
        base.execute("CREATE VIRTUAL TABLE t USING fts5(name, qualified_name, signature)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without fts5")
    base.executemany("INSERT INTO t(rowid, name, qualified_name, signature) VALUES (?, ?, ?, ?)", [(k + 1, *r) for k, r in enumerate(rows)])
    for query in ("save", "process_al", "gru", "all process", "mod1", "NAIVE", "x", "save_al things", "zzz", "self"):
        asked = " ".join(f'"{w}"*' for w in __import__("re").findall(r"\w+", query))
        expected = {k - 1: round(s, 6) for k, s in base.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (asked,))}
        got = {r.symbol_id: round(r.score, 6) for r in search.token_matches(index, query).collect()}
        assert got == expected, query
    assert search.token_matches(index, "!!").count() == 0


def test_ranked_search(spark, root, store):
    indexing.build(spark, root, store, 1.0)
    best, total = search.ranked_search(store.read(), "save")
    rows = best.collect()
    assert [(r.qualified_name, r.match_tier) for r in rows] == [("Repo.save", 3), ("save_all", 2), ("keep", 0)] and total.first()[0] == 3
    assert all(0 <= r.popularity <= 1 and 0 <= r.locality <= 1 and 0 <= r.recency <= 1 for r in rows)
    heavy, _ = search.ranked_search(store.read(), "save", weights=search.Weights(match=0.0, popularity=9.0))
    assert heavy.first().qualified_name == "save_all"


def test_budget(spark):
    lines = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([4000, 8, 0, 400])], "rn int, line string")
    assert budget.answer(lines, 4, 5, 700).lines == ("x" * 4000,)
    short = lines.where("rn > 0")
    said = budget.answer(short, 9, 5, 100, ("note",))
    assert said.render() == "x" * 8 + "\n\ntruncated: true, total_matches: 9\nindex_age_ms: 5\nnote"
    assert budget.Answer((), False, 0, 0).render() == "index_age_ms: 0"


def test_grep(spark):
    texts = spark.createDataFrame([("b.py", "x = 1\r\n  foo(2)\n"), ("a.py", "foo\n\nfoo")], "path string, text string")
    assert scan.grep_report(texts, r"foo(?!\()") == "a.py:1: foo\na.py:3: foo"
    assert scan.grep_report(texts, "(").startswith("not a regular expression") and scan.grep_report(texts, "zzz") == "(no line matches)"
    assert scan.grep_report(texts, "foo", most=2).split("\n")[2:] == ["(2 lines are shown, others match as well)"]
    assert len(scan.grep_report(texts, "foo", most=3).split("\n")) == 3
    assert sorted(map(tuple, scan.grep(texts, "foo").collect())) == [("a.py", 1, "foo"), ("a.py", 3, "foo"), ("b.py", 2, "foo(2)")]


TASKS = {"repository": "shop", "tasks": [{"id": "t1", "split": "dev", "question": "where?", "check": {"type": "location", "file": "app.py", "line_between": [4, 6]}}, {"id": "t2", "split": "holdout", "question": "which?", "check": {"type": "contains_all", "values": ["Repo", "app.py"]}}]}


def test_episodes_end_to_end(spark, root, tmp_path):
    """Recorded turns are played against both contestants; the log is scored again."""
    shutil.copytree(root, tmp_path / "repos" / "shop")
    (tmp_path / "tasks.json").write_text(json.dumps(TASKS))
    turns = [{"tool_calls": [{"name": "read_file", "arguments": {"path": "app.py"}}, {"name": "read_file", "arguments": {"path": "lib/core.py"}}, {"name": "grep", "arguments": {"pattern": "class"}}], "prompt_tokens": 100, "completion_tokens": 50}, {"answer": "see app.py:5", "prompt_tokens": 150, "completion_tokens": 50}]
    (tmp_path / "rec.json").write_text(json.dumps({"episodes": {"t1": {"turns": turns}, "t2": {"turns": [{"prompt_tokens": 1, "completion_tokens": 1}]}}}))
    model = benchmarking.Replay.load(spark, str(tmp_path / "rec.json"))
    table = benchmarking.run(spark, str(tmp_path / "tasks.json"), model, str(tmp_path / "repos"), str(tmp_path / "log.jsonl"), repetitions=2, split="all")
    assert "| grep | 50.0% | 4 | 176 | 2 to 350 | 0.5 |" in table and "| sparkindex | 50.0% | 4 |" in table
    log = records.read_log(spark, str(tmp_path / "log.jsonl"))
    rows = {(r.task, r.contestant, r.rep): r for r in evaluation.rebuild_episodes(log, records.read_tasks(spark, str(tmp_path / "tasks.json"))).collect()}
    r = rows["t1", "grep", 0]
    assert (r.success, r.total_tokens, r.wasted_reads) == (True, 350, 1) and not rows["t2", "grep", 1].success
    told = {(x.task, x.contestant, x.rep): x for x in log.where("kind = 'result'").collect()}
    assert {k: (x.success, x.total_tokens, x.wasted_reads) for k, x in told.items()} == {k: (x.success, x.total_tokens, x.wasted_reads) for k, x in rows.items()}
    assert all(x.task_id == x.task and x.repetition == x.rep and x.wall_seconds >= 0 for x in told.values())


def test_episode_limits(tmp_path):
    class Endless:
        name = "none"

        def tools(self):
            return []

        def turn(self, messages, tools):
            return benchmarking.Turn((("strange", {}),), None, 10, 10)

    one, log = Endless(), io.StringIO()
    task = {"id": "t", "question": "q"}
    assert benchmarking.run_episode(task, one, one, str(tmp_path), log, max_steps=3)["failure"] == "step-cap"
    assert benchmarking.run_episode(task, one, one, str(tmp_path), log, token_cap=30)["failure"] == "token-cap"
    put(tmp_path, {"f.py": "".join(f"line {k}\n" for k in range(1, 301))})
    read = lambda **asked: benchmarking.read_window(str(tmp_path), {"path": "f.py"} | asked)
    assert read(start_line=299) == "299: line 299\n300: line 300" and read(start_line=2, end_line=3) == "2: line 2\n3: line 3"
    assert len(read().split("\n")) == len(read(end_line=999).split("\n")) == 200 and read(start_line=5, end_line=4) == read(start_line=400) == ""
    assert "not readable" in read(path="no") and "not readable" in benchmarking.read_window(str(tmp_path), {})


def test_final_answer_ends_an_episode(tmp_path):
    class Answers:
        name = "none"

        def __init__(self, *turns):
            self.turns = [*turns]

        def tools(self):
            return []

        def turn(self, messages, tools):
            assert messages[0]["role"] == "system" and "final_answer" in tools
            return self.turns.pop(0)

    put(tmp_path, {"a.py": "x = 1\n", "b.py": "y = 1\n"})
    reads = benchmarking.Turn((("read_file", {"path": "a.py"}), ("read_file", {"path": "b.py"}), ("final_answer", {"text": ""}), ("read_file", {"path": "c.py"})), None, 1, 1)
    model, log = Answers(reads, benchmarking.Turn((("final_answer", {"text": "in a.py"}),), None, 1, 1)), io.StringIO()
    got = benchmarking.run_episode({"id": "t", "question": "q"}, model, model, str(tmp_path), log, judge=lambda check, answer: answer == "in a.py", clock=iter(range(9)).__next__)
    assert (got["success"], got["wasted_reads"], got["total_tokens"], got["wall_seconds"], got["failure"]) == (True, 1, 4, 3, None)
    assert [json.loads(x)["kind"] for x in log.getvalue().splitlines()] == ["model", "tool", "tool", "model", "result"]


def test_records(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"repositories": [{"name": "a", "url": "u", "commit": "0" * 40}, {"name": "b", "url": "u", "commit": "HEAD"}]}))
    assert {r.name: r.valid for r in records.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {"a": True, "b": False}
    assert len(records.repository_id(str(tmp_path))) == 16
    assert records.cache_root({"XDG_CACHE_HOME": "/x"}) == "/x/sparkindex" and records.cache_root({"XDG_CACHE_HOME": "rel"}).endswith(".cache/sparkindex")
    origin = tmp_path / "origin"
    put(origin, {"a.py": "x = 1\n"})
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "one"]):
        subprocess.run(["git", *command], cwd=origin, check=True)
    commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=origin, check=True, capture_output=True, text=True).stdout.strip()
    assert [benchmarking.check_out("r", str(origin), commit, str(tmp_path / "repos")) for _ in range(2)] == ["cloned", "up-to-date"]
    put(origin, {".gitignore": "b.py\n", "b.py": "", "-c.py": ""})
    for command in (["add", ".gitignore"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "two"]):
        subprocess.run(["git", *command], cwd=origin, check=True)
    later = subprocess.run(["git", "rev-parse", "HEAD"], cwd=origin, check=True, capture_output=True, text=True).stdout.strip()
    assert benchmarking.check_out("r", str(origin), later, str(tmp_path / "repos")) == "updated" and (tmp_path / "repos" / "r" / ".gitignore").exists()
    assert tree.ignored(str(origin), ["a.py", "b.py", "-c.py", "node_modules/x.js"]) == {"b.py", "node_modules/x.js"}


def test_producer_tells_changes(spark, root, store, tmp_path):
    indexing.build(spark, root, store, 1.0)
    producer = watch.Producer(root, str(tmp_path / "events"))
    assert producer.look() == 0
    put(root, {"late.py": "def unseen(): pass\n", "lib/core.py": "def other(): pass\n", "notes.txt": "no"})
    os.remove(f"{root}/web/api.ts")
    assert producer.look() == 3 and producer.look() == 0
    watch.watch(spark, root, store, watch.read_events(spark, str(tmp_path / "events")), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    kept = store.read()
    assert {r.path for r in lookups.indexed_paths(kept).collect()} == {"app.py", "late.py", "lib/core.py", "web/ui.tsx"}
    assert lookups.find_definition(kept, "unseen").count() == lookups.find_definition(kept, "other").count() == 1


def test_command_line(spark, root, tmp_path, capsys):
    where = ["--repo", root, "--store", str(tmp_path / "cli")]

    def run(*arguments):
        code = facade.main([arguments[0], *where, *arguments[1:]], spark)
        return code, capsys.readouterr().out.strip()

    assert run("stats")[0] == 1 and run("query")[0] == 2 and facade.main(["index", "--repo", str(tmp_path / "nope")], spark) == 1
    capsys.readouterr()
    code, out = run("index", "--json")
    assert code == 0 and json.loads(out)["indexed"] == 4
    assert run("stats", "--json") == (0, '{"files": 4, "symbols": 9, "refs": 7}')
    assert run("query", "Repo.save") == (0, "Repo.save  method  app.py:5  def save(self)")
    assert run("query", "sav")[1].startswith("save_all") or "save" in run("query", "sav")[1]
    assert run("query", "app.py", "--outline")[1].split("\n")[2] == "    5    save  method  def save(self)"
    assert run("query", "--repo-map", "--limit", "1")[1] == "lib/core.py  (python, 2 symbols, 1 inbound)  save_all, process"
    assert json.loads(run("query", "save_all", "--references", "--json")[1])[0]["confidence"] == "import"
    assert run("check") == (0, "no drift")
    put(root, {"z.py": "q = 1\n"})
    assert run("check")[0] == 1
    said = facade.CodeIndex(spark, root, str(tmp_path / "cli"))
    assert "Repo.save  method" in said.search_symbols("save") and "Try grep" in said.outline_file("gone.py")
    assert facade.CodeIndex(spark, root, str(tmp_path / "none")).repo_map().endswith("without being indexed.")


def test_other_schema_version_is_rebuilt(spark, root, store):
    indexing.build(spark, root, store, 1.0)
    path = f"{store.root}/manifests/{store.versions()[-1]:012d}.json"
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    for checksum in glob.glob(f"{store.root}/manifests/.*.crc"):
        os.remove(checksum)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(manifest | {"schema_version": 0}, f)
    assert not store.exists() and store.read().files.isEmpty()
    assert indexing.build(spark, root, store, 2.0).indexed == 4 and store.exists()


def test_periodic_sweep_makes_good_lost_events(spark, root, store, tmp_path):
    indexing.build(spark, root, store, 1.0)
    put(root, {"late.py": "def unseen(): pass\n"})
    query = watch.sweep_every(spark, root, store, str(tmp_path / "sweep"), "2 seconds")
    try:
        for _ in range(60):
            if lookups.find_definition(store.read(), "unseen").count():
                break
            time.sleep(1)
    finally:
        query.stop()
    assert lookups.find_definition(store.read(), "unseen").count() == 1 and query.exception() is None
