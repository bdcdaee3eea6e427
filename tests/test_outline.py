"""Outlines of source files: worked examples of each language, and that nothing breaks the reader."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.outline import BRACES, outline
from tessera.operators import ingest

# language, source, chunks (name, kind, first and last line, visibility), calls, imports
EXAMPLES = [
    ("rust", "fn a(){ x(); }\nfoo();\n// bar()\n", [("a", "function", 1, 1, None)], [("a", "x"), ("<module>", "foo")], []),
    ("rust", "/* fn ghost() { a(); } /* nested */ b() */\n#[derive(Debug)]\npub(crate) struct P { f: fn(u8) -> u8 }\nstruct Own;\nenum E { A(u8) }", [("P", "struct", 3, 3, "pub(crate)"), ("Own", "struct", 4, 4, None), ("E", "enum", 5, 5, None)], [], []),
    ("rust", "pub fn load<'a, T: Into<u8>>(x: &'a str) -> Result<u8, E> {\n  let y = parse::inner::deep(x);\n  let s = \"baz(1)\"; let c = '{'; let r = r#\"fn no() { \"x\" }\"#;\n  y.get::<u8>(0).map(|q| helper(q))\n}", [("load", "function", 1, 5, "pub")], [("load", "inner::deep"), ("load", "y.get::<u8>"), ("load", "y.get::<u8>(0).map"), ("load", "helper")], []),
    ("rust", "fn m(y: R) { if let Some(v) = f(y) { println!(\"{}\", inner(v)) }\n match y { Ok(z) => z.go(), Err(_) => vec![1].len(), } }", [("m", "function", 1, 2, None)], [("m", "f"), ("m", "println"), ("m", "z.go"), ("m", "vec"), ("m", "[1].len")], []),
    ("rust", "impl<T> Display for Own<T> where T: X {\n  fn hidden(&self) -> u8 { self.a.b(2) }\n}\nimpl Own { }\ntrait Q { fn sig(&self); fn def(&self) { self.sig() } }", [("Display for Own<T>", "impl", 1, 3, None), ("Own", "impl", 4, 4, None), ("Q", "trait", 5, 5, None)], [("hidden", "self.a.b"), ("def", "self.sig")], []),
    ("rust", "pub use std::io::{\n  Read};\nconst N: usize = size();\nmod tests { use super::*; fn t() { assert_eq!(1, 2); } }\ntype A = Vec<u8>;", [("N", "const", 3, 3, None), ("tests", "module", 4, 4, None), ("A", "type", 5, 5, None)], [("<module>", "size"), ("t", "assert_eq")], ["pub use std::io::{\n  Read};", "use super::*;"]),
    ("javascript", "function a(){ x(); }\nfoo();\n// bar()\nconst s = \"baz(1)\";\n", [("a", "function", 1, 1, None), ("s", "const", 4, 4, None)], [("a", "x"), ("<module>", "foo")], []),
    ("javascript", "import { x } from './mod'\nexport default class Box extends Base {\n  static async run(a) { go(`t ${inner(a)} {`); }\n  get v() { return this.run(1) }\n  field = make();\n}\nexport { y } from 'z'\nlet re = /fn(\\/)\"/.test(s)", [("Box", "export", 2, 6, None), (None, "export", 7, 7, None), ("re", "const", 8, 8, None)], [("run", "go"), ("run", "inner"), ("v", "this.run"), ("<module>", "make"), ("<module>", "/fn(\\/)\"/.test")], ["import { x } from './mod'"]),
    ("javascript", "const f = async (q) => {\n  return q.map(r => r.go())\n    .filter(Boolean)\n}\nif (a) { function inner2() { deep() } }\nexport const K = new Map(one())", [("f", "const", 1, 4, None), ("inner2", "function", 5, 5, None), ("K", "export", 6, 6, None)], [("<module>", "q.map"), ("<module>", "r.go"), ("<module>", "q.map(r => r.go())\n    .filter"), ("inner2", "deep"), ("<module>", "one")], []),
    ("typescript", "class K {\n  run(a: number): void { go(); }\n  private x?: () => void;\n}\ninterface P { call(x: number): void }\nexport interface Q { a: string }\ntype Z = (a: number) => void\nabstract class W { m() { n() } }", [("K", "class", 1, 4, None), (None, "export", 6, 6, None)], [("run", "go"), ("m", "n")], []),
    ("tsx", "export function App<T>({ p }: P): JSX.Element {\n  const [s, set] = useState<string>('')\n  return <div onClick={() => set(fmt(s))}>it's {render(p)}</div>\n}", [("App", "export", 1, 4, None)], [("App", "useState"), ("App", "set"), ("App", "fmt"), ("App", "render")], []),
    ("go", "package main\nimport (\n  \"os\"\n)\ntype T struct { a int; f func(x int) error }\ntype I interface { Do(x int) error }\nfunc (t *T) Main(x int) (int, error) {\n  fmt.Println(low(`raw { fn() `))\n  go func() { later() }()\n  return 1, nil\n}\nfunc low() int { return 1 }", [("T", "type", 5, 5, None), ("I", "type", 6, 6, None), ("Main", "function", 7, 11, None), ("low", "function", 12, 12, None)], [("Main", "fmt.Println"), ("Main", "low"), ("Main", "later")], ["import (\n  \"os\"\n)"]),
    ("java", "import java.util.List;\n@Service(\"x\")\npublic class D extends B {\n  private final int x = init();\n  @Override public <T> List<T> get(String s) throws E { return this.repo.find(s, 'c').all(); }\n  abstract void nothing();\n}\ninterface I { void f(int x); }\nenum Z { Q; protected int g() { return h(); } }", [("D", "class", 2, 7, "public"), ("I", "interface", 8, 8, None), ("g", "function", 9, 9, "protected")], [("<module>", "init"), ("get", "this.repo.find"), ("get", "this.repo.find(s, 'c').all"), ("g", "h")], ["import java.util.List;"]),
    ("c", "#define CALL(x) fn(x) \\\n  more(x)\nstruct foo { int a; int (*cb)(int); };\nstatic int add(int a, struct foo *f);\nint add(int a, struct foo *f) {\n  if (a) { printf(\"%d {\", sub(a)); }\n  return f->cb(a); }", [("foo", "struct", 3, 3, None), ("add", "function", 5, 7, None)], [("add", "printf"), ("add", "sub"), ("add", "f->cb")], []),
    ("cpp", "namespace n { class K : public B { public: K(int a) : x(a) { init(); } void go() const { v.push_back(f<int>(1)); } int y(); }; }\ntemplate <typename T> T K::run(T a) { return this->go(a); }\nint main() { auto s = R\"(fn() {)\"; n::k::call(); }", [("K", "class", 1, 1, None), ("run", "function", 2, 2, None), ("main", "function", 3, 3, None)], [("K", "init"), ("go", "v.push_back"), ("go", "f<int>"), ("run", "this->go"), ("main", "k::call")], []),
    ("kotlin", "import a.b.C\nclass A { fun go(x: Int): Int { return call(x) } }\nfun one() = two()\n", [("A", "class", 2, 2, None), ("one", "function", 3, 3, None)], [("go", "call"), ("one", "two")], ["import a.b.C"]),
    ("php", "<?php\nuse A\\B;\nclass K { public function run($a) { $this->go($a); # no()\n foo(\"x\"); } }", [("K", "class", 3, 4, None)], [("run", "$this->go"), ("run", "foo")], ["use A\\B;"]),
    ("swift", "import UIKit\npublic struct S { func go() { run(1) } }", [("S", "struct", 2, 2, "public")], [("go", "run")], ["import UIKit"]),
]


@pytest.mark.parametrize("language,source,chunks,calls,imports", EXAMPLES)
def test_examples(language, source, chunks, calls, imports):
    got = outline(source, language)
    assert [(c.name, c.kind, c.start_line, c.end_line, c.visibility) for c in got.chunks] == chunks
    assert got.calls == calls and got.imports == imports


_PARTS = ["fn ", "function ", "class ", "export ", "const ", "impl<", "struct ", "func ", "import ", "use ", "pub ", "a", "b.c", "::", "(", ")", "{", "}", "[", "]", "<", ">", ";", "\n", "'", '"', "`", "${", "/*", "*/", "//", "/", "#", "=", "=>", "->", "!", ",", "public ", "interface ", "~", ":", "@x", "type ", "$", "\\", "é"]


@pytest.mark.parametrize("language", BRACES)
@given(st.lists(st.sampled_from(_PARTS), max_size=40))
@settings(max_examples=150, deadline=2000)
def test_nothing_breaks_the_reader(language, parts):
    got = outline("".join(parts), language)
    ends = [(c.start_line, c.end_line) for c in got.chunks]
    assert all(1 <= a <= b <= "".join(parts).count("\n") + 1 for a, b in ends) and all(x and y for x, y in got.calls)


def test_chunks_and_edges_of_files(spark):
    files = [
        (1, "a.rs", "pub use std::io::{Read};\npub fn load(x: u8) {\n    helper(y)\n}\n"), (1, "b.tsx", "import { x } from './mod'\nclass K { run(a) { go(); } }"), (1, "c.go", "import \"fmt\"\nfunc Main() { fmt.Println() }"),
        (2, "e.py", "import os.path\ndef f():\n    g()\nclass C: pass\nh()"), (2, "bad.py", "def (:\n x"), (2, "n.md", "one\ntwo"), (2, "none.rs", None), (2, "plain.rs", "// only words\n\nand more"), (None, "x", "y"),
    ]
    df = spark.createDataFrame(files, "project_id long, file_path string, content string")
    got = {(r["file_path"], r["chunk_name"], r["chunk_kind"], r["visibility"], r["start_line"], r["end_line"], r["content"]) for r in ingest.code_chunks(df).collect()}
    assert got == {
        ("a.rs", "load", "function", "pub", 2, 4, "pub fn load(x: u8) {\n    helper(y)\n}"), ("b.tsx", "K", "class", None, 2, 2, "class K { run(a) { go(); } }"), ("c.go", "Main", "function", None, 2, 2, "func Main() { fmt.Println() }"),
        ("e.py", "f", "function", None, 2, 3, "def f():\n    g()"), ("e.py", "C", "class", None, 4, 4, "class C: pass"),
        ("bad.py", None, None, None, 1, 2, "def (:\n x"), ("n.md", None, None, None, 1, 2, "one\ntwo"), ("plain.rs", None, None, None, 1, 3, "// only words\n\nand more"), ("x", None, None, None, 1, 1, "y"),
    }
    edges = {(r["project_id"], r["source_entity"], r["target_entity"], r["edge_type"], r["source_file"]) for r in ingest.code_edges(df).collect()}
    assert edges == {
        (1, "a.rs", "std::io", "uses", "a.rs"), (1, "load", "helper", "calls", "a.rs"), (1, "b.tsx", "./mod", "uses", "b.tsx"), (1, "run", "go", "calls", "b.tsx"), (1, "c.go", '"fmt"', "uses", "c.go"), (1, "Main", "fmt.Println", "calls", "c.go"),
        (2, "e.py", "os.path", "uses", "e.py"), (2, "f", "g", "calls", "e.py"), (2, "<module>", "h", "calls", "e.py"),
    }
    plan = ingest.code_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert ingest.code_edges(df.limit(0)).count() == 0


def test_batches_of_files_have_a_bounded_size(spark):
    rows = spark.newSession().range(0, 3000, 1, 1).select(F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("a/"), "id", F.lit(".py")).alias("file_path"), F.concat(F.lit("x("), "id", F.lit(")")).alias("content"))
    sizes = []
    for texts in (True, False):
        items = ingest.outlines(rows, texts)
        sizes.append({(r["what"], r["content"] is None) for r in items.select("what", "content").distinct().collect()})
    assert sizes == [{("call", True), ("file", False)}, {("call", True), ("file", True)}]
    many = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r["n"] for r in many.collect()) <= 2000
    large = rows.limit(100).withColumn("content", F.repeat("content", 20_000)).coalesce(1)
    held = large.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert max(r["n"] for r in held.collect()) <= 6 << 20
