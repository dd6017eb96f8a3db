"""From what code says to the file, node or module it means: all equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from ..staging import stage
from .graph import G
from .register import ARCHITECTURAL

HIT = [G, "hit_id"]
# fixed values: endings tried in order for a script import
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
JS_ROOTS = ("src", "app", "components", "services", "utils")
DATA_ENDINGS = (".csv", ".tsv", ".parquet", ".jsonl")
ENV_ENDINGS = (".env", ".env.example", ".env.local")


def _key(index: str, key: Column) -> Column:
    return F.struct(F.lit(index).alias("idx"), key.alias("key"))


def candidates(hits: DataFrame) -> DataFrame:
    """Per hit the ordered keys to look up (``keys``), and those that ask for the nearest file (``near``)."""
    here, spec = F.col("_here"), F.col("spec")
    is_py = F.col("kind").isin("py_from", "py_import")
    path = lambda c: _key("path", c)
    none = F.array().cast("array<struct<idx:string,key:string>>")

    relative = spec.startswith("./") | spec.startswith("../")
    rooted = spec.startswith("/") | spec.startswith("@/") | F.substring_index(spec, "/", 1).isin(*JS_ROOTS) & spec.contains("/")
    clean = F.when(spec.startswith("@/"), F.concat(F.lit("src/"), F.substr(spec, F.lit(3)))).otherwise(spec)
    js_base = F.when(relative, p.join_path(here, clean)).otherwise(p.normal_path(clean))
    base = F.col("_base")
    js = F.when(relative | rooted, F.array(*[path(F.concat(base, F.lit(e))) for e in JS_ENDINGS], _key("dotted", base))).otherwise(none)

    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.when(dots > 1, F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(
        F.size(F.split(here, "/")) - (dots - 1), F.lit(0))), "/")).otherwise(here)
    py_base = F.when(dots == 0, F.replace(spec, F.lit("."), F.lit("/"))).otherwise(F.when(tail == "", up).otherwise(p.join_path(up, tail)))
    up_base = tail = F.col("_base")  # with dots and without
    items = F.coalesce("items", F.array().cast("array<string>"))
    each = lambda root: F.flatten(F.transform(items, lambda i: F.array(
        path(p.normal_path(F.concat(root, F.lit("/"), i, F.lit(".py")))),
        path(p.normal_path(F.concat(root, F.lit("/"), i, F.lit("/__init__.py")))))))
    of_items = lambda root: F.transform(items, lambda i: path(p.normal_path(F.concat(root, F.lit("/"), i, F.lit(".py")))))
    in_here = F.when(here == "", tail).otherwise(F.concat(here, F.lit("/"), tail))
    # found once for a hit, not once for each of its keys
    hits = hits.withColumn("_here", p.parent_dir(F.col("path"))).withColumn(
        "_base", F.when(F.col("kind") == "js", js_base).when(is_py, py_base))
    py = F.when(dots > 0, F.concat(
        F.array(path(F.concat(up_base, F.lit(".py"))), path(F.concat(up_base, F.lit("/__init__.py")))), each(up_base),
        F.array(_key("stem", F.lower(F.substring_index(up_base, "/", -1)))))).otherwise(F.concat(
            F.array(path(F.concat(tail, F.lit(".py"))), path(F.concat(tail, F.lit("/__init__.py"))),
                    path(p.normal_path(F.concat(in_here, F.lit(".py")))),
                    path(p.normal_path(F.concat(in_here, F.lit("/__init__.py"))))),
            of_items(tail), of_items(in_here)))
    py_near = F.when(dots == 0, F.concat(
        F.array(_key("stem", F.lower(F.substring_index(tail, "/", -1)))),
        F.transform(items, lambda i: _key("stem", F.lower(i))))).otherwise(none)

    package = spec.startswith("package:")
    dart = F.when(package, none).when(F.endswith(spec, F.lit(".dart")), F.array(path(p.join_path(here, spec)))).otherwise(none)
    dart_near = F.when(package, F.array(_key("base", F.lower(F.substring_index(spec, "/", -1))))).otherwise(none)
    last = lambda sep: F.substring_index(spec, sep, -1)
    dotted_file = F.concat(F.replace(spec, F.lit("."), F.lit("/")), F.lit(".java"))
    java = F.array(_key("suffix", dotted_file), _key("stem.java", F.lower(last("."))))
    ruby = F.when(F.endswith(spec, F.lit(".rb")), spec).otherwise(F.concat(spec, F.lit(".rb")))
    by_kind = {
        "js": js, "py_from": py, "py_import": py, "dart": dart, "java": java,
        "go": F.array(_key("go", last("/"))),
        "cpp": F.array(path(p.join_path(here, spec)), _key("base", F.lower(last("/")))),
        "cs": F.array(_key("stem.cs", F.lower(last(".")))), "rb": F.array(path(p.join_path(here, ruby))),
        "php": F.array(path(p.join_path(here, spec))), "php_use": F.array(_key("stem.php", F.lower(last("\\")))),
        "rust": F.array(path(p.join_path(here, F.concat(spec, F.lit(".rs")))), path(p.join_path(here, F.concat(spec, F.lit("/mod.rs"))))),
        "model": F.array(path(p.join_path(here, spec))), "data": F.array(path(p.join_path(here, spec))),
    }
    near = {"py_from": py_near, "py_import": py_near, "dart": dart_near,
            "model": F.array(_key("base", F.lower(last("/")))), "data": F.array(_key("base", F.lower(last("/")))),
            "any_data": F.array(_key("all", F.lit("data"))), "env": F.array(_key("all", F.lit("env")))}
    pick = lambda table: F.coalesce(*[F.when(F.col("kind") == name, c) for name, c in table.items()], none)
    return hits.withColumn("keys", pick(by_kind)).withColumn("near", pick(near)).drop("_here", "_base")


def file_index(files: DataFrame) -> DataFrame:
    """(idx, key, path): every way a file can be asked for; linear in the length of its path."""
    path = F.col("path")
    ext, name = p.extension(path), p.base_name(path)
    parts = F.split(path, "/")
    size = F.size(parts)
    stem = F.lower(p.stem(path))
    typed = lambda e, idx: F.when(ext == e, F.array(_key(idx, stem))).otherwise(F.array().cast("array<struct<idx:string,key:string>>"))
    none = F.array().cast("array<struct<idx:string,key:string>>")
    pieces = F.split(path, r"\.")
    dotted = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
                         lambda i: _key("dotted", F.array_join(F.slice(pieces, F.lit(1), i), ".")))
    suffixes = F.transform(F.sequence(F.lit(1), size),
                           lambda i: _key("suffix", F.array_join(F.slice(parts, i, size), "/")))
    inner = F.when(size > 2, F.transform(F.slice(parts, F.lit(2), size - 2), lambda s: _key("go", s))).otherwise(none)
    go = F.when(ext == ".go", F.concat(inner, F.when(size > 1, F.array(_key("go", p.stem(path)))).otherwise(none))).otherwise(none)
    of = lambda endings, label: F.when(
        F.exists(F.array(*[F.lit(e) for e in endings]), lambda e: F.endswith(path, e)), F.array(_key("all", F.lit(label)))).otherwise(none)
    entries = F.concat(
        F.array(_key("path", path), _key("stem", stem), _key("base", F.lower(name))),
        F.when(F.size(pieces) > 1, dotted).otherwise(none), F.when(ext == ".java", suffixes).otherwise(none),
        typed(".java", "stem.java"), typed(".cs", "stem.cs"), typed(".php", "stem.php"), go,
        of(DATA_ENDINGS, "data"), of(ENV_ENDINGS, "env"))
    return files.select(G, "path", F.explode(F.array_distinct(entries)).alias("e")).select(
        G, "e.idx", "e.key", F.col("path").alias("target"))


def nearest(asks: DataFrame, index: DataFrame) -> DataFrame:
    """Best of many files per ask: first those outside the asking folder, then the longest common
    start with ``ref``, then the smallest path.

    Keys with one file need no contest.  For the others, files are indexed by each start of
    their path and the character after it; an ask looks up its own starts.  So the work is
    linear in path lengths and no ask meets every file of a crowded key.
    """
    wanted = asks.select(G, "idx", "key").distinct()
    offered = index.join(wanted, [G, "idx", "key"], "left_semi")
    tally = stage(offered.groupBy(G, "idx", "key").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))).df
    sole = asks.join(tally.filter("n = 1").select(G, "idx", "key", "target"), [G, "idx", "key"])
    crowded = tally.filter("n > 1").select(G, "idx", "key")
    crowd = index.join(crowded, [G, "idx", "key"], "left_semi")
    contested = asks.join(crowded, [G, "idx", "key"], "left_semi")

    def starts(df, text, fields):
        spread = df.select(*fields, text, F.explode(F.sequence(F.lit(0), F.length(text))).alias("len"))
        return spread.withColumn("start", F.substr(text, F.lit(1), F.col("len"))).withColumn(
            "after", F.substr(text, F.col("len") + 1, F.lit(1)))
    offers = starts(crowd, F.col("target"), [G, "idx", "key"]).groupBy(G, "idx", "key", "start", "after").agg(
        F.min("target").alias("target")).withColumnRenamed("after", "t_after")
    # who asks for the same from the same place gets the same answer
    place = [G, "idx", "key", "ref", "folder"]
    seek = starts(contested.select(*place).distinct(), F.col("ref"), ["folder", G, "idx", "key"])
    met = seek.join(offers, [G, "idx", "key", "start"]).filter(
        (F.col("after") != F.col("t_after")) | ((F.col("after") == "") & (F.col("t_after") == "")))
    inside = F.col("len") >= F.length("folder")
    best = met.groupBy(*place).agg(
        F.min(F.struct(inside.alias("i"), (-F.col("len")).alias("l"), F.col("target").alias("t"))).alias("b"))
    won = contested.join(best.select(*place, F.col("b.t").alias("target")), place)
    found = sole.select(*HIT, "rank", "target").unionByName(won.select(*HIT, "rank", "target"))
    return found.groupBy(*HIT).agg(F.min_by("target", "rank").alias("target"))


def resolve(hits: DataFrame, files: DataFrame, prefer_near: bool = False) -> DataFrame:
    """Target file of every hit: first key that exists, else the nearest file by name.

    The nearest rule prefers files outside the asking folder; ``prefer_near`` turns that off.
    """
    if "items" not in hits.columns:
        hits = hits.withColumn("items", F.lit(None).cast("array<string>"))
    once = hits.dropDuplicates([G, "path", "line", "kind", "spec", "type"])
    cand = stage(candidates(once).withColumn("hit_id", F.monotonically_increasing_id())).df  # numbers are fixed once written
    index = stage(file_index(files)).df
    first = index.groupBy(G, "idx", "key").agg(F.min("target").alias("target"))
    asked = cand.select(*HIT, F.posexplode("keys").alias("rank", "k")).select(*HIT, "rank", "k.idx", "k.key")
    exact = stage(asked.join(first, [G, "idx", "key"]).groupBy(*HIT).agg(F.min_by("target", "rank").alias("target"))).df
    open_hits = cand.join(exact, HIT, "left_anti")
    folder = p.parent_dir(F.col("path"))
    ref = F.when(F.col("kind").isin("py_from", "py_import"), folder).otherwise(F.col("path"))
    asks = open_hits.select(*HIT, (F.lit("") if prefer_near else folder).alias("folder"), ref.alias("ref"),
                            F.posexplode("near").alias("rank", "k")).select(
                                *HIT, "folder", "ref", "rank", "k.idx", "k.key")
    near = nearest(stage(asks).df, index)
    return cand.join(exact.unionByName(near), HIT).select(
        G, F.col("path").alias("src_path"), "line", "kind", "spec", "type", "method", F.col("target").alias("dst_path"))


def external_libraries(hits: DataFrame, resolved: DataFrame, stdlib: tuple[str, ...], dart_libs: tuple[str, ...]) -> DataFrame:
    """Root packages of imports that no file of the graph answers."""
    known = resolved.select(G, F.col("src_path").alias("path"), "line", "kind", "spec")
    py = hits.filter(F.col("kind").isin("py_from", "py_import") & ~F.col("spec").startswith(".")).join(
        known, [G, "path", "line", "kind", "spec"], "left_anti").select(G, "path", F.substring_index("spec", ".", 1).alias("library"))
    package = hits.filter((F.col("kind") == "dart") & F.col("spec").startswith("package:"))
    root = F.substring_index(F.substr(F.col("spec"), F.lit(9)), "/", 1)
    dart = package.join(known, [G, "path", "line", "kind", "spec"], "left_anti").select(G, "path", root.alias("library"))
    listed = package.filter(root.isin(*dart_libs)).select(G, "path", root.alias("library"))
    return py.filter(~F.col("library").isin(*stdlib)).unionByName(dart).unionByName(listed).distinct()


def file_dependencies(resolved: DataFrame) -> DataFrame:
    """First dependency per (source, target, type), none on itself."""
    return resolved.filter("src_path <> dst_path").groupBy(G, "src_path", "dst_path", "type").agg(
        F.min_by(F.struct("line", "spec", "method"), F.struct("line", "spec")).alias("r")).select(
            G, "src_path", "dst_path", "type", "r.*")


def match_endpoints(calls: DataFrame, route: DataFrame) -> DataFrame:
    """File that serves each called endpoint.

    An endpoint matches itself, else the first defined route it lies below.  Among the
    files that define that route the closest by folder wins; files are indexed by every
    folder above them with their depth, so an ask looks up its own folders only.
    """
    calls = calls.select(G, "path", "line", "endpoint").distinct()
    calls = stage(calls.withColumn("hit_id", F.monotonically_increasing_id())).df
    known = route.groupBy(G, F.col("endpoint").alias("ep")).agg(F.min(F.struct("path", "line")).alias("defined"))
    tidy = known.withColumn("below", F.regexp_replace("ep", "/+$", ""))
    exact = calls.join(known.select(G, F.col("ep").alias("endpoint")), [G, "endpoint"]).select(
        *HIT, F.col("endpoint").alias("ep"))
    rest = calls.join(exact, HIT, "left_anti").select(*HIT, F.explode(p.ancestors(F.col("endpoint"))).alias("below"))
    under = rest.join(tidy.filter("ep <> '/'"), [G, "below"]).groupBy(*HIT).agg(F.min_by("ep", "defined").alias("ep"))
    matched = calls.join(exact.unionByName(under), HIT)
    # closest defining file: over shared folders, its depth against the caller's
    depth = F.size(F.split("path", "/"))
    folders = lambda: F.concat(F.array(F.lit("")), p.prefixes(F.col("path")))
    offers = route.select(G, F.col("endpoint").alias("ep"), "path", "line", "verb", depth.alias("d"),
                          F.posexplode(folders()).alias("shared", "folder")).groupBy(G, "ep", "folder", "shared").agg(
        F.min(F.struct("d", "path", "line", "verb")).alias("o"))
    asks = matched.select(*HIT, "ep", depth.alias("own"), F.explode(folders()).alias("folder"))
    away = F.col("own") + F.col("o.d") - 2 * F.col("shared")
    best = asks.join(offers, [G, "ep", "folder"]).groupBy(*HIT).agg(
        F.min(F.struct(away.alias("away"), F.col("o.path").alias("path"), F.col("o.line").alias("line"), F.col("o.verb").alias("verb"))).alias("b"))
    out = calls.join(best, HIT).select(
        G, F.col("path").alias("src_path"), "line", "endpoint", F.col("b.path").alias("dst_path"),
        F.concat_ws(" ", "b.verb", "endpoint").alias("statement"))
    return out.filter("src_path <> dst_path").groupBy(G, "src_path", "dst_path", "endpoint").agg(
        F.min("line").alias("line"), F.min_by("statement", "line").alias("statement"))


def owning_node(files: DataFrame, nodes: DataFrame, node_files: DataFrame) -> DataFrame:
    """Node of every file: listed, else longest folder, else a folder named like a node, else the first service.

    ``nodes`` needs graph_id, node_id, type, pos, folder; ``node_files`` is (graph_id, node_id, path).
    """
    order = nodes.select(G, "node_id", "pos")
    listed = node_files.join(order, [G, "node_id"]).groupBy(G, "path").agg(F.min_by("node_id", "pos").alias("n1"))
    # all but the listed nodes, and those whose folder is the path itself, follow from the folder that a file is in
    placed = files.select(G, "path", p.folder_of(F.col("path")).alias("dir"))
    dirs = stage(placed.filter("dir IS NOT NULL").select(G, "dir").distinct()).df
    home = nodes.filter("folder IS NOT NULL AND folder <> 'root' AND folder <> ''").groupBy(G, "folder").agg(
        F.min_by("node_id", "pos").alias("n"))
    at_path = home.select(G, F.col("folder").alias("path"), F.col("n").alias("n2"))
    above = dirs.select(G, "dir", F.explode(p.prefixes(F.col("dir"))).alias("folder"))
    by_folder = above.join(home, [G, "folder"]).groupBy(G, "dir").agg(F.max_by("n", F.length("folder")).alias("n2_dir"))
    segments = F.transform(F.split("dir", "/"), lambda s: F.array(p.safe_id(s), p.safe_id(F.concat(F.lit("mod-"), s))))
    chains = F.transform(p.prefixes(F.col("dir")), lambda s: F.array(p.safe_id(F.concat(F.lit("mod-"), s)), p.safe_id(s)))
    named = dirs.select(G, "dir", F.posexplode(F.flatten(F.concat(segments, chains))).alias("rank", "node_id"))
    by_name = named.join(nodes.select(G, "node_id"), [G, "node_id"]).groupBy(G, "dir").agg(F.min_by("node_id", "rank").alias("n3"))
    by_dir = by_folder.join(by_name, [G, "dir"], "full")
    service = nodes.filter(F.col("type").isin("Service", "Application")).groupBy(G).agg(F.min_by("node_id", "pos").alias("n4"))
    row = (placed.join(by_dir, [G, "dir"], "left").join(listed, [G, "path"], "left").join(at_path, [G, "path"], "left")
           .join(service, G, "left"))
    return row.select(G, "path", F.coalesce("n1", "n2", "n2_dir", "n3", "n4").alias("node_id"))


def owning_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Module of every file: its path or a folder above it; of several the last by position."""
    above = files.select(G, "path", F.explode(p.prefixes(F.col("path"))).alias("folder"))
    return above.join(modules.select(G, "folder", "module_id", "pos"), [G, "folder"]).groupBy(G, "path").agg(
        F.max_by("module_id", "pos").alias("module_id"))


def lift_to_nodes(deps: DataFrame, owner: DataFrame) -> DataFrame:
    """File dependencies between different nodes, one edge per (src, dst, type)."""
    a = owner.select(G, F.col("path").alias("src_path"), F.col("node_id").alias("src"))
    b = owner.select(G, F.col("path").alias("dst_path"), F.col("node_id").alias("dst"))
    kind = (F.when(F.col("type").isin(*ARCHITECTURAL), F.col("type"))
            .when(F.col("type").isin("IMPORTS", "REQUIRES", "INCLUDES"), "USES").otherwise("CALLS"))
    lifted = deps.withColumn("type", kind).join(a, [G, "src_path"]).join(b, [G, "dst_path"]).filter("src <> dst")
    return lifted.groupBy(G, "src", "dst", "type").agg(F.min(F.struct("src_path", "line")).alias("at")).select(
        G, "src", "dst", "type", F.col("at.src_path").alias("ev_file"), F.col("at.line").alias("ev_line"))


def module_dependencies(deps: DataFrame, file_module: DataFrame) -> DataFrame:
    """How many file dependencies go from one module to another, with the first as evidence."""
    a = file_module.select(G, F.col("path").alias("src_path"), F.col("module_id").alias("src_module"))
    b = file_module.select(G, F.col("path").alias("dst_path"), F.col("module_id").alias("dst_module"))
    both = deps.join(a, [G, "src_path"]).join(b, [G, "dst_path"]).filter("src_module <> dst_module")
    return both.groupBy(G, "src_module", "dst_module").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("src_path", "line")).alias("at")).select(
            G, "src_module", "dst_module", "n", F.col("at.src_path").alias("ev_file"), F.col("at.line").alias("ev_line"))


def lift_module_dependencies(module_deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Module dependencies both of whose modules are nodes."""
    ids = nodes.select(G, "node_id")
    return (module_deps.join(ids.withColumnRenamed("node_id", "src_module"), [G, "src_module"], "left_semi")
            .join(ids.withColumnRenamed("node_id", "dst_module"), [G, "dst_module"], "left_semi")
            .select(G, F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), F.lit("USES").alias("type"), "n"))
