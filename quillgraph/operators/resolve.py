"""From captures to edges: enclosing symbols, import targets, and the three-step name resolver, all as joins.

Tables: symbols (id, kind, name, path, start_line, end_line, ...) and captures (schema.CAPTURES) with
role `call`, `implements`, `extends`, `import` (variant 1 named, 2 namespace, 3 default; `qualifier` is
a renamed import's local name).  Paths use forward slashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking
from .state import cut

#: Confidence of the resolver's steps.
SAME_FILE, IMPORTED, UNIQUE = 1.0, 0.9, 0.7
#: Suffixes that an import of a TypeScript file is tried with, in this order.
SUFFIXES = ("", ".ts", ".tsx", "/index.ts", "/index.tsx")
#: Extensions that an import is tried with in a JavaScript or TypeScript tree, in this order.
EXTENSIONS = (".ts", ".tsx", ".js", ".mjs", ".cjs", ".cts", ".mts", ".jsx")
#: Source extensions that stand behind an import of a JavaScript file.
TWINS = {".js": (".ts", ".tsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs"), ".jsx": (".tsx", ".jsx")}
ROLE_KIND = {"call": "Calls", "implements": "Implements", "extends": "Extends", "import": "Imports"}


def _blocks(level: Column) -> tuple[Column, Column]:
    """Of lines s to e the first whole block of 2 ** level lines, and the one behind the last."""
    return F.negative(F.call_function("shiftright", F.negative(F.col("s")), level)), F.call_function("shiftright", F.col("e") + 1, level)


def enclosing(captures: DataFrame, symbols: DataFrame) -> DataFrame:
    """Captures with `from_id`, the smallest symbol of their file whose lines hold them; captures outside of all fall away.

    Lines s to e are cut into at most two blocks of 2 ** k lines for each k, and of the symbols that a block
    belongs to only the best stays.  A line lies in one block of each size, so it meets one row of each size and
    all joins are by equal keys, however many symbols and captures a file has.
    """
    lines = symbols.groupBy("path", F.col("start_line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e")).agg(F.min("id").alias("id")).where("s <= e")
    best = F.struct((F.col("e") - F.col("s")).alias("span"), F.col("s").alias("s"), F.col("id").alias("from_id"))
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.col("e") - F.col("s") + 1)).cast("int"))
    each = lines.select("path", "s", "e", best.alias("best"), F.explode(sizes).alias("level"))
    first, behind = _blocks(F.col("level"))
    ends = F.filter(F.array(F.when(first % 2 != 0, first), F.when(behind % 2 != 0, behind - 1)), lambda x: x.isNotNull())
    cover = each.where(first < behind).select("path", "level", F.explode(ends).alias("block"), "best")
    held = cover.groupBy("path", "level", "block").agg(F.min("best").alias("best"))
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())  # one for each power of two up to the longest symbol
    places = captures.select("path", "row").distinct().select("path", "row", F.explode(F.lit(levels or [0]).cast("array<int>")).alias("level"))
    places = places.withColumn("block", F.call_function("shiftright", F.col("row").cast("long"), F.col("level")))
    found = places.join(held, ["path", "level", "block"]).groupBy("path", "row").agg(F.min("best")["from_id"].alias("from_id"))
    return captures.distinct().join(found, ["path", "row"]).select(*captures.columns, "from_id")


def import_base(from_file: Column, source: Column) -> Column:
    """A relative import's path from the repository's top; null for imports of packages."""
    d = tx.dirname(from_file)
    return F.when(source.startswith("."), tx.normalize_path(F.when(d == "", source).otherwise(F.concat(d, F.lit("/"), source))))


def _once(base: Column, candidates: Callable[[Column], Column]) -> Column:
    """Candidates of a path that is computed once and not for each of them."""
    return F.transform(F.array(base), candidates)[0]


def script_candidates(base: Column) -> Column:
    """Candidate paths of a TypeScript import in order: without a JavaScript extension first, then as it stands."""
    return _once(base, _script_candidates)


def _script_candidates(base: Column) -> Column:
    bare = F.when(base.endswith(".js"), F.regexp_replace(base, r"\.js$", "")).when(base.endswith(".jsx"), F.regexp_replace(base, r"\.jsx$", "")).otherwise(base)
    return F.array(*[F.concat(b, F.lit(s)) for b in (bare, base) for s in SUFFIXES])


def tree_candidates(base: Column) -> Column:
    """Candidate paths in a JavaScript or TypeScript tree: the file, its source twins, with an extension, as a folder's index."""
    return _once(base, _tree_candidates)


def _tree_candidates(base: Column) -> Column:
    root, ext = F.regexp_extract(base, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(base, r"(\.[^./]*)$", 1)
    twins = reduce(lambda acc, kv: F.when(ext == kv[0], F.array(*[F.concat(root, F.lit(t)) for t in kv[1]])).otherwise(acc), TWINS.items(), F.array().cast("array<string>"))
    return F.concat(F.array(base), twins, F.array(*[F.concat(base, F.lit(x)) for x in EXTENSIONS]), F.array(*[F.concat(base, F.lit("/index" + x)) for x in EXTENSIONS]))


def first_existing(imports: DataFrame, files: DataFrame, candidates: str, out: str = "target_file") -> DataFrame:
    """Each row with the first of its candidate paths that is a file (path), null if none is."""
    tagged = imports.withColumn("_row", F.struct(*imports.columns))
    tried = tagged.select("_row", F.posexplode(candidates).alias("pos", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("_row").agg(F.min_by("path", "pos").alias(out))
    return tagged.join(found, "_row", "left").drop("_row", candidates)


def resolve_imports(captures: DataFrame, files: DataFrame) -> DataFrame:
    """Import captures with their target file, null where none is indexed."""
    wanted = captures.where("role = 'import'").withColumn("tries", script_candidates(import_base(F.col("path"), F.col("source"))))
    return first_existing(wanted, files, "tries")


def alias_declarations(imports: DataFrame) -> DataFrame:
    """file, alias, target_file, target_member of resolved imports; of repeated (file, alias) the first."""
    member = F.when(F.col("variant") == 1, F.col("name")).when(F.col("variant") == 3, F.lit("default"))
    rows = imports.where("target_file IS NOT NULL").select(F.col("path").alias("file"), F.coalesce("qualifier", "name").alias("alias"), "target_file", member.alias("target_member"), "byte")
    return ranking.first_wins(rows, ["file", "alias"], [F.col("byte"), F.col("target_file")]).drop("byte")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """path and the id of its first symbol."""
    return symbols.groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("from_id"))


def by_file_and_name(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path", "name").agg(F.min("id").alias("id"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """name and id of the names that only one symbol has."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def import_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (path, target): the files that a file's Imports edges lead to."""
    s = symbols.select("id", "path")
    e = edges.where("kind = 'Imports'").join(s.select(F.col("id").alias("from_id"), "path"), "from_id")
    return e.join(s.select(F.col("id").alias("to_id"), F.col("path").alias("target")), "to_id").select("path", "target").distinct()


def resolve_names(refs: DataFrame, symbols: DataFrame, targets: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """References (ref, path, name and, for namespaces, qualifier) with to_id and confidence, null if unresolved.

    In order: the namespace's file at 0.9; the same file at 1.0; a file it imports at 0.9 (the first by
    path); a globally unique name at 0.7.  Never anything else.
    """
    here = by_file_and_name(symbols)
    step1 = refs.join(here.withColumnRenamed("id", "id1"), ["path", "name"], "left")
    via = refs.select("path", "name").distinct().join(targets, "path").join(here.select(F.col("path").alias("target"), "name", F.col("id").alias("id2")), ["target", "name"])
    step2 = step1.join(via.groupBy("path", "name").agg(F.min_by("id2", F.struct("target", "id2")).alias("id2")), ["path", "name"], "left")
    out = step2.join(unique_names(symbols).withColumnRenamed("id", "id3"), "name", "left")
    steps = [("id1", SAME_FILE), ("id2", IMPORTED), ("id3", UNIQUE)]
    if namespaces is not None:
        ns = namespaces.select(F.col("file").alias("path"), F.col("alias").alias("qualifier"), "target_file").distinct()
        inside = here.select(F.col("path").alias("target_file"), "name", F.col("id").alias("id0"))
        found = refs.where("qualifier IS NOT NULL").select("path", "qualifier", "name").distinct().join(ns, ["path", "qualifier"]).join(inside, ["target_file", "name"])
        out = out.join(found.groupBy("path", "qualifier", "name").agg(F.min("id0").alias("id0")), ["path", "qualifier", "name"], "left")
        steps.insert(0, ("id0", IMPORTED))
    to = F.coalesce(*[F.col(c) for c, _ in steps])
    conf = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(v)) for c, v in steps])
    return out.select(*refs.columns, to.alias("to_id"), conf.alias("confidence"))


def resolve_by_alias(refs: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """References whose local name is a renamed or default import, resolved through its declaration at 0.9.

    A default import resolves if the target file has one symbol only; the plain resolver leaves both kinds unresolved.
    """
    a = aliases.where("target_member IS NOT NULL").select(F.col("file").alias("path"), F.col("alias").alias("name"), "target_file", "target_member")
    here = by_file_and_name(symbols).select(F.col("path").alias("target_file"), F.col("name").alias("target_member"), F.col("id").alias("named"))
    only = symbols.groupBy(F.col("path").alias("target_file")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one")).where("n = 1").drop("n")
    out = refs.join(a, ["path", "name"], "left").join(here, ["target_file", "target_member"], "left").join(only, "target_file", "left")
    to = F.coalesce("named", F.when(F.col("target_member") == "default", F.col("one")))
    return out.select(*refs.columns, to.alias("to_id"), F.when(to.isNotNull(), F.lit(IMPORTED)).alias("confidence"))


def build_edges(symbols: DataFrame, captures: DataFrame, use_aliases: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges, alias declarations and attempts (kind, confidence or null) of a repository's captures.

    Imports come first, since the resolver's second step reads them.  Self edges fall away but for
    Imports.  Of repeated (from, to, kind) the first attempt stays, a namespaced one before a plain one.
    """
    files = symbols.select("path").distinct()
    imports = cut(resolve_imports(captures, files))
    aliases = alias_declarations(imports)
    named = imports.where("variant <> 2").join(first_symbols(symbols), "path")
    target = by_file_and_name(symbols).select(F.col("path").alias("target_file"), "name", F.col("id").alias("to_id"))
    import_tries = named.join(target, ["target_file", "name"], "left").select(F.lit("Imports").alias("kind"), "from_id", "to_id", F.when(F.col("to_id").isNotNull(), F.lit(1.0)).alias("confidence"), F.lit(0).alias("pass"), "path", "byte", F.lit(0).alias("plain"))
    lost_namespaces = imports.where("variant = 2 AND target_file IS NULL").select(F.lit("Imports").alias("kind"), F.lit(None).cast("long").alias("from_id"), F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("pass"), "path", "byte", F.lit(0).alias("plain"))
    import_edges = import_tries.where("to_id IS NOT NULL").select("from_id", "to_id", "kind", "confidence")
    # a member call is tried twice, once with its object as a namespace and once by name alone
    found = cut(enclosing(captures.where("role <> 'import'"), symbols))
    twice = found.where("qualifier IS NOT NULL").withColumn("qualifier", F.lit(None).cast("string"))
    refs = found.unionByName(twice)
    resolved = resolve_names(refs, symbols, import_targets(import_edges, symbols), aliases.where("target_member IS NULL"))
    if use_aliases:
        open_ = resolved.where("to_id IS NULL").drop("to_id", "confidence")
        resolved = resolved.where("to_id IS NOT NULL").unionByName(resolve_by_alias(open_, symbols, aliases))
    kind = reduce(lambda acc, kv: F.when(F.col("role") == kv[0], F.lit(kv[1])).otherwise(acc), ROLE_KIND.items(), F.lit(None))
    tries = resolved.where("to_id IS NULL OR to_id <> from_id").select(kind.alias("kind"), "from_id", "to_id", "confidence", F.lit(1).alias("pass"), "path", "byte", F.col("qualifier").isNull().cast("int").alias("plain"))
    attempts = import_tries.unionByName(lost_namespaces).unionByName(tries)
    stored = ranking.first_wins(attempts.where("to_id IS NOT NULL"), ["from_id", "to_id", "kind"], [F.col("pass"), F.col("path"), F.col("byte"), F.col("plain")])
    return stored.select("from_id", "to_id", "kind", "confidence"), aliases, attempts.select("kind", "confidence")


def edge_stats(attempts: DataFrame) -> DataFrame:
    """kind, resolved, unresolved: attempts, not stored rows."""
    return attempts.groupBy("kind").agg(F.count_if(F.col("confidence").isNotNull()).alias("resolved"), F.count_if(F.col("confidence").isNull()).alias("unresolved"))
