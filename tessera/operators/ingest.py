"""Ingestion of source text: scan, filters, chunks, code edges and the incremental merge."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.batches import settle, tidy
from tessera.functions import text as tx
from tessera.functions.outline import BRACES, Chunk, Outline, outline

# fixed values: what is not indexed
BINARY = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "wav", "avi", "mov", "zip", "gz", "tar", "bz2", "xz", "7z",
    "rar", "exe", "dll", "so", "dylib", "o", "a", "wasm", "pdf", "doc", "docx", "xls", "xlsx", "ttf", "otf", "woff", "woff2", "eot", "pyc",
    "pyo", "class", "jar", "db", "sqlite", "sqlite3", "bin", "dat", "onnx", "pt", "pb",
]
SKIP_PREFIXES = ["target/", "node_modules/", ".git/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", ".next/", ".nuxt/", "vendor/", ".cargo/", "pkg/"]
SKIP_FILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".DS_Store", "Thumbs.db"]
# fixed values: how a line that begins a chunk begins
_SCRIPT = ["function ", "export function ", "export default function ", "class ", "export class ", "const ", "export const "]
_MANAGED = ["public class ", "class ", "public interface ", "interface ", "public ", "private ", "protected "]
_NATIVE = ["void ", "int ", "char ", "struct ", "class ", "namespace "]
BOUNDARIES = {
    "rust": ["pub fn ", "fn ", "pub struct ", "struct ", "pub enum ", "enum ", "impl ", "pub trait ", "trait ", "pub mod ", "mod ", "pub const ", "pub type "],
    "python": ["def ", "async def ", "class "], "javascript": _SCRIPT, "typescript": _SCRIPT, "go": ["func ", "type "], "java": _MANAGED, "kotlin": _MANAGED,
    "ruby": ["def ", "class ", "module "], "php": ["function ", "class ", "interface "], "c": _NATIVE, "cpp": _NATIVE, "swift": ["func ", "class ", "struct ", "enum ", "protocol "],
}
MAX_LINES = 80


def indexable(path: str | Column) -> Column:
    """Paths relative to the project that are neither binary by extension nor skipped; hidden parts are skipped too."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.coalesce(tx.extension(p), F.lit(""))
    skip = F.lit(False)
    for x in SKIP_PREFIXES:
        skip = skip | p.startswith(x)
    for x in SKIP_FILES:
        skip = skip | p.endswith(x)
    return ~(ext.isin(BINARY) | skip | p.rlike(r"(^|/)\.[^/]"))


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """A line of an ignore file that stands in `folder`, as a regular expression of paths and whether it takes a path back
    in; None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    anchored = "/" in line[:-1]
    body, out, i = line.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            end = body.find("]", i + 2) if c == "[" else -1
            if end > 0:
                out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    start = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
    return f"^{start}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if line.endswith('/') else '(?:/.*)?'}$", back


def ignored(path: str | Column, rules: dict[str, list[str]]) -> Column:
    """Whether ignore files (folder -> lines, '' for the root) leave a path out: the last rule that fits decides, and those
    of deeper folders come later. Folders are decided first: nothing under an excluded one comes back."""
    from tessera.sources.folder import rule_of

    p = F.col(path) if isinstance(path, str) else path
    found = []
    for folder in sorted(rules, key=lambda f: (f.strip("/").count("/") + bool(f.strip("/")), f)):
        found += [r for r in (rule_of(line, folder) for line in rules[folder]) if r]

    def out(x: Column, is_folder: bool) -> Column:
        said = F.lit(False)
        for expression, back, only in found:
            if is_folder or not only:
                said = F.when(x.rlike(expression), F.lit(not back)).otherwise(said)
        return said

    parts = F.split(p, "/")
    folders = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(folders, lambda f: out(f, True)) | out(p, False)


def scan(spark: SparkSession, root: str, ignore: dict[str, list[str]] | None = None) -> DataFrame:
    """(file_path, content) of a folder's text files; what its ignore files, or `ignore` besides (see ignored), leave out
    isn't read, nor are bytes that aren't UTF-8 returned. Folders are listed by the tasks that read them."""
    from tessera.sources.folder import register

    register(spark)
    rows = spark.read.format("folder").load(root).select("file_path", "content")
    return rows.where(~ignored("file_path", ignore)) if ignore else rows


def chunk_lines(files: DataFrame, language: str | Column = "language", most: int = MAX_LINES) -> DataFrame:
    """files' columns but content, with start_line, end_line (from 1, inclusive) and the chunk's content.

    A chunk begins at a line that begins like a definition of the file's language, and after `most` lines. All of it
    is within a row: no shuffle, and a file's lines never leave it. Empty files give none.
    """
    lang = F.col(language) if isinstance(language, str) else language
    body = F.regexp_replace("content", r"\r?\n$", "")
    lines = F.when(F.coalesce("content", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))
    rule = F.create_map(*[x for k, v in BOUNDARIES.items() for x in (F.lit(k), F.lit(r"^\s*(" + "|".join(v) + ")"))])
    rows = files.withColumn("__lines", lines).withColumn("__rule", F.try_element_at(rule, lang))
    starts = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: (i == 0) | (F.col("__rule").isNotNull() & F.rlike(F.get("__lines", i), F.col("__rule"))))
    rows = rows.where(F.size("__lines") > 0).withColumn("__starts", starts)
    spans = F.transform("__starts", lambda s, k: F.struct(s.alias("a"), F.coalesce(F.get("__starts", k + 1), F.size("__lines")).alias("b")))
    cut = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["a"], s["b"] - 1, F.lit(most)), lambda i: F.struct(i.alias("a"), F.least(i + most, s["b"]).alias("b")))))
    rows = rows.withColumn("__c", F.explode(cut))
    kept = [c for c in files.columns if c != "content"]
    text = F.array_join(F.slice("__lines", F.col("__c.a") + 1, F.col("__c.b") - F.col("__c.a")), "\n")
    return rows.select(*kept, (F.col("__c.a") + 1).alias("start_line"), F.col("__c.b").alias("end_line"), text.alias("content"))


class _Calls(ast.NodeVisitor):
    """Calls with the function they stand in, imports, and the outermost definitions."""

    def __init__(self, path: str):
        self.path, self.within, self.edges, self.chunks = path, "<module>", [], []

    def visit_FunctionDef(self, node):
        if self.within == "<module>" and not getattr(self, "inside", False):
            self.chunks.append((node.name, "function", node.lineno, node.end_lineno))
        before, self.within = self.within, node.name
        self.generic_visit(node)
        self.within = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        if not getattr(self, "inside", False) and self.within == "<module>":
            self.chunks.append((node.name, "class", node.lineno, node.end_lineno))
        before, self.inside = getattr(self, "inside", False), True
        self.generic_visit(node)
        self.inside = before

    def visit_Call(self, node):
        self.edges.append((self.within, ast.unparse(node.func), "calls"))
        self.generic_visit(node)

    def visit_Import(self, node):
        self.edges += [(self.path, n.name, "uses") for n in node.names]

    def visit_ImportFrom(self, node):
        self.edges.append((self.path, "." * node.level + (node.module or ""), "uses"))


def python_edges(files: DataFrame) -> DataFrame:
    """(project_id, source_entity, target_entity, edge_type, source_file) of Python files, by the standard parser.

    Other languages have no parser here, so they give no edges; files that don't parse give none either.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for project, path, content in pdf.itertuples(index=False):
                try:
                    found = _Calls(path)
                    found.visit(ast.parse(content or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += [(project, s, t, k, path) for s, t, k in found.edges]
            yield pd.DataFrame(out, columns=["project_id", "source_entity", "target_entity", "edge_type", "source_file"])

    rows = files.where(tx.language("file_path") == "python").select("project_id", "file_path", "content")
    return rows.mapInPandas(run, "project_id long, source_entity string, target_entity string, edge_type string, source_file string").distinct()


def python_chunks(files: DataFrame) -> DataFrame:
    """(file_path, chunk_name, chunk_kind, start_line, end_line): outermost definitions of Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in pdf.itertuples(index=False):
                try:
                    found = _Calls(path)
                    found.visit(ast.parse(content or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += [(path, *c) for c in found.chunks]
            yield pd.DataFrame(out, columns=["file_path", "chunk_name", "chunk_kind", "start_line", "end_line"])

    rows = files.where(tx.language("file_path") == "python").select("file_path", "content")
    return rows.mapInPandas(run, "file_path string, chunk_name string, chunk_kind string, start_line int, end_line int")


_ITEMS = "project_id long, file_path string, language string, what string, name string, kind string, visibility string, start_line int, end_line int, target string, content string"


def _python_outline(path: str, source: str) -> Outline:
    found = _Calls(path)
    found.visit(ast.parse(source))
    chunks = [Chunk(name, kind, a, b, None) for name, kind, a, b in found.chunks]
    return Outline(chunks, [(s, t) for s, t, k in found.edges if k == "calls"], [f"from {t} import" for _, t, k in found.edges if k == "uses"])


def outlines(files: DataFrame, texts: bool = True) -> DataFrame:
    """What is in files (project_id, file_path, content), a row an item: definitions ('chunk'), calls ('call': `name` is the
    function, `target` what it calls), imports ('import': `target` is the statement), and, of a file without definitions or
    of a language that has no outline, the file ('file'). Each file is read once, within its row's batch; nothing is shuffled.
    Without `texts` the content of chunks and files is null. A batch has a bounded size, whatever the table's.
    """
    settle(files.sparkSession)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for project, path, language, source in pdf.itertuples(index=False):
                source, found = source or "", Outline()
                try:
                    if language == "python":
                        found = _python_outline(path, source)
                    elif language in BRACES:
                        found = outline(source, language)
                except (SyntaxError, ValueError, RecursionError):
                    pass  # a file that doesn't parse as Python is cut by lines
                head, lines = (project, path, language), source.split("\n") if texts and found.chunks else []
                out += [(*head, "chunk", c.name, c.kind, c.visibility, c.start_line, c.end_line, None, "\n".join(lines[c.start_line - 1 : c.end_line]) if texts else None) for c in found.chunks]
                out += [(*head, "call", s, None, None, None, None, t, None) for s, t in found.calls]
                out += [(*head, "import", None, None, None, None, None, t, None) for t in found.imports]
                if not found.chunks:
                    out.append((*head, "file", None, None, None, None, None, None, source if texts else None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _ITEMS.split(", ")])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("project_id", "file_path", tx.language("file_path").alias("language"), "content").mapInPandas(run, _ITEMS)


def code_chunks(files: DataFrame) -> DataFrame:
    """(project_id, file_path, language, chunk_name, chunk_kind, visibility, start_line, end_line, content): the outermost
    definitions of each file; a file without any is cut by lines, and its chunks have no name."""
    items = outlines(files)
    cols = ["project_id", "file_path", "language", F.col("name").alias("chunk_name"), F.col("kind").alias("chunk_kind"), "visibility", "start_line", "end_line", "content"]
    cut = chunk_lines(items.where("what = 'file'").drop("start_line", "end_line"))
    return items.where("what = 'chunk'").select(*cols).unionByName(cut.select(*cols))


def code_edges(files: DataFrame) -> DataFrame:
    """(project_id, source_entity, target_entity, edge_type, source_file): calls by the function that they stand in, or
    <module>, and imports by the file."""
    items = outlines(files, texts=False)
    is_call = F.col("what") == "call"
    target = F.when(is_call, F.col("target")).otherwise(tx.import_path(F.regexp_replace("target", r"^pub(\([^)]*\))?\s+", "")))
    rows = items.where("what IN ('call', 'import')").select(
        "project_id", F.when(is_call, F.col("name")).otherwise(F.col("file_path")).alias("source_entity"), target.alias("target_entity"), F.when(is_call, "calls").otherwise("uses").alias("edge_type"), F.col("file_path").alias("source_file"),
    )
    return rows.where("target_entity <> ''").distinct()


def definitions(files: DataFrame) -> DataFrame:
    """(project_id, file_path, chunk_name, chunk_kind, visibility, start_line, end_line) of named chunks. 'public' is what
    the source says, in Go a capital, in Python no leading underscore, in C and C++ always; otherwise 'private'."""
    rows = outlines(files, texts=False).where("what = 'chunk' AND name IS NOT NULL")
    said = F.coalesce(F.col("visibility").isin("public", "open") | F.col("visibility").startswith("pub"), F.lit(False)) | (F.col("kind") == "export")
    shown = F.when(F.col("language") == "go", F.col("name").rlike("^[A-Z]")).when(F.col("language") == "python", ~F.col("name").startswith("_")).when(F.col("language").isin("c", "cpp"), F.lit(True)).otherwise(said)
    return rows.select("project_id", "file_path", F.col("name").alias("chunk_name"), F.col("kind").alias("chunk_kind"), F.when(shown, "public").otherwise("private").alias("visibility"), "start_line", "end_line")


def callee(name: str | Column) -> Column:
    """The last two segments of a path by double colons."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.size(F.split(c, "::")) > 2, F.substring_index(c, "::", -2)).otherwise(c)


def index_plan(files: DataFrame, chunks: DataFrame, version: int = 1) -> DataFrame:
    """(file_path, file_hash, action): 'skip' where hash and version still hold, 'index' for others, 'delete' for files gone."""
    w = Window.partitionBy("file_path").orderBy(F.desc("indexed_at"), F.desc("behavior_version"))
    known = chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("file_path", F.col("file_hash").alias("old"), "behavior_version")
    new = files.select("file_path", tx.sha256("content").alias("file_hash"))
    action = F.when(F.col("file_hash").isNull(), "delete").when((F.col("file_hash") == F.col("old")) & (F.col("behavior_version") >= version), "skip").otherwise("index")
    return new.join(known, "file_path", "full").select("file_path", "file_hash", action.alias("action"))


def merge_chunks(chunks: DataFrame, new: DataFrame, plan: DataFrame) -> DataFrame:
    """Stored chunks after an indexing: files gone and lines that no longer begin a chunk are out, new chunks in.

    Where nothing was scanned at all nothing is deleted, as an empty scan is more likely a failure.
    """
    from tessera.operators.state import upsert_chunks

    if plan.where("action <> 'delete'").isEmpty():
        return chunks
    gone = plan.where("action = 'delete'").select("file_path")
    changed = plan.where("action = 'index'").select("file_path")
    still = chunks.join(gone, "file_path", "left_anti")
    stale = still.join(changed, "file_path", "left_semi").join(new.select("project_id", "file_path", "start_line"), ["project_id", "file_path", "start_line"], "left_anti").select("project_id", "file_path", "start_line")
    return upsert_chunks(still.join(stale, ["project_id", "file_path", "start_line"], "left_anti"), new)


def counters(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") != "delete").alias("files_scanned"), F.count_if(F.col("action") == "index").alias("files_changed"), F.count_if(F.col("action") == "skip").alias("files_skipped"), F.count_if(F.col("action") == "delete").alias("files_deleted"))
