"""Source trees as tables: files read in parallel, filtered by path, decoded where they are valid text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scan

#: Folders that an index skips, those that the JavaScript and TypeScript analysis skips, and its extensions.
SKIP = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv")
SKIP_SCRIPTS = ("node_modules", "dist", "build", ".git", "coverage", ".next", ".turbo", "out")
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".mjs", ".cts", ".mts", ".cjs", ".jsx")


def language_of(path: Column) -> Column:
    """`typescript`, `python`, or null for files that no extractor reads or that lie in skipped folders."""
    skipped = F.exists(F.split(tx.norm_slashes(path), "/"), lambda c: c.isin(*SKIP))
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    return F.when(~skipped & ext.isin("ts", "tsx"), "typescript").when(~skipped & (ext == "py"), "python")


def is_script(path: Column) -> Column:
    """Whether the import analysis looks at a file: its extension, no skipped and no hidden folder."""
    folders = F.split(tx.dirname(path), "/")
    skipped = F.exists(folders, lambda c: c.isin(*SKIP_SCRIPTS) | c.startswith("."))
    return ~skipped & F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(*SCRIPT_EXTENSIONS)


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A .gitignore line as (regular expression over relative paths, whether it takes files back in)."""
    line = pattern.rstrip("\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back


def not_ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether .gitignore rules (folder of the file, line), outermost first, leave a path in; the last that applies decides."""
    out = F.lit(True)
    for folder, line in rules:
        rule = ignore_regex(line)
        if rule:
            prefix = f"{folder}/" if folder else ""
            inside = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(F.lit("")) if prefix else path
            hit = inside.rlike(rule[0]) & (inside != "")
            out = F.when(hit, F.lit(rule[1])).otherwise(out)
    return out


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, line) of every .gitignore of a tree, outermost first.  Spark's readers pass over hidden files, so the file system is asked itself."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/")
    found, listed = [], fs.listFiles(base, True)
    while listed.hasNext():
        p = listed.next().getPath()
        if p.getName() == ".gitignore":
            stream = fs.open(p)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            folder = p.getParent().toString()[len(top) :].strip("/")
            found.append((folder.count("/") + bool(folder), folder, text))
    return [(folder, line) for _, folder, text in sorted(found) for line in text.splitlines()]


def read_tree(spark: SparkSession, root: str, gitignore: bool = True, glob: str | None = "*.{ts,tsx,py}") -> DataFrame:
    """path (relative, forward slashes) and content of the tree's files that are valid UTF-8.

    Hidden files stay out, as does what .gitignore excludes unless asked for.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (files.option("pathGlobFilter", glob) if glob else files).load(root)
    whole = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    rows = rows.withColumn("path", F.substring(whole, len(re.sub("^file:/+", "file:/", base)) + 2, 1 << 30))
    rows = rows.where(~F.exists(F.split("path", "/"), lambda c: c.startswith(".")))
    if gitignore:
        rows = rows.where(not_ignored(F.col("path"), ignore_rules(spark, root)))
    text = F.col("content").cast("string")
    return rows.where(F.is_valid_utf8(text)).select("path", text.alias("content"))


def import_specs(text: str) -> list[str]:
    """What a script imports, re-exports, requires or loads, in order: the string behind `from`, a bare `import`, or a call of `import` or `require`."""
    tokens = scan.tokenize(text)
    out, waiting = [], False
    for k, (kind, word, _) in enumerate(tokens):
        before = tokens[k - 1][1] if k else ""
        if kind == "word" and word in ("import", "export") and before not in (".", "?."):
            waiting = True  # for the statement's `from`
        elif kind == "string" and len(word) > 2:
            called = before == "(" and k > 1 and tokens[k - 2][1] in ("import", "require") and (k < 3 or tokens[k - 3][1] not in (".", "?."))
            if before == "import" and waiting or before == "from" and waiting or called:
                out.append(word[1:-1])
            waiting = False
        elif word == ";":
            waiting = False
    return out


def script_imports(files: DataFrame) -> DataFrame:
    """path and spec of every import in JavaScript or TypeScript sources (path, content), comments aside."""

    def run(batches):
        for batch in batches:
            found = [(path, spec) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for spec in import_specs(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["path", "spec"])

    return files.select("path", "content").mapInArrow(run, "path string, spec string")


def script_graph(files: DataFrame) -> DataFrame:
    """src, dst: distinct imports between the files of a tree; packages and unknown targets are left out."""
    from ..operators import resolve

    wanted = script_imports(files).distinct().withColumn("base", resolve.import_base(F.col("path"), F.col("spec"))).where("base IS NOT NULL")
    tried = wanted.withColumn("tries", resolve.tree_candidates(F.col("base"))).drop("base")
    hit = resolve.first_existing(tried, files, "tries")
    return hit.where("target_file IS NOT NULL AND target_file <> path").select(F.col("path").alias("src"), F.col("target_file").alias("dst")).distinct()
