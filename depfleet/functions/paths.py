"""Keys and parts of paths, ids and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_key(node_id: Column) -> Column:
    """Identity of a node across versions."""
    return F.lower(F.trim(node_id))


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    """Identity of an edge across versions; the type keeps its case."""
    return F.concat(node_key(src), F.lit("->"), node_key(dst), F.lit(":"), kind)


def file_key(path: Column) -> Column:
    """Lower case, forward slashes, without one leading ./ and then one leading /."""
    slashed = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return F.trim(F.regexp_replace(F.regexp_replace(slashed, r"^\./", ""), r"^/", ""))


def folder_key(path: Column) -> Column:
    """As a file key, also without one trailing slash."""
    slashed = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(F.regexp_replace(slashed, r"^\./", ""), r"^/", "")
    return F.trim(F.regexp_replace(bare, r"/$", ""))


def safe_id(name: Column, profile: str = "full") -> Column:
    """Name as an id.  ``full`` collapses runs of dashes, ``lite`` cuts to 48 characters."""
    dashed = F.regexp_replace(F.lower(F.trim(name)), r"[^a-zA-Z0-9_\-]", "-")
    if profile == "lite":
        return F.substring(dashed, 1, 48)
    bare = F.regexp_replace(F.regexp_replace(dashed, r"-+", "-"), r"^-+|-+$", "")
    return F.when(bare == "", "unknown-component").otherwise(bare)


def display_name(name: Column, profile: str = "full") -> Column:
    """Words of an id with capitals.  ``full`` lowers the rest of each word, ``lite`` keeps it."""
    if profile == "lite":
        words = F.split(F.regexp_replace(name, r"[-_]", " "), " ")
        return F.array_join(F.transform(
            words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    words = F.filter(F.split(name, r"[-_]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, _capital), " ")
    return F.when(joined == "", _capital(name)).otherwise(joined)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_of(path: Column) -> Column:
    """Everything before the last slash; null without one."""
    return F.when(path.contains("/"), F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1))


def ancestors(path: Column) -> Column:
    """Every proper prefix folder of a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def prefixes(path: Column) -> Column:
    """The path itself and its ancestors: turns a prefix join into an equi join."""
    return F.concat(ancestors(path), F.array(path))


def normal_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` above the start is kept."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (F.when((part == "") | (part == "."), done)
                .when(up, F.slice(done, F.lit(1), F.size(done) - 1))
                .otherwise(F.concat(done, F.array(part))))
    walked = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(~path.rlike(r"(^|/)\.{0,2}(/|$)"), path).otherwise(walked)  # most paths have nothing to resolve


def join_path(folder: Column, rest: Column) -> Column:
    """Normalised ``folder/rest``."""
    return normal_path(F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest)))


def path_distance(a: Column, b: Column) -> Column:
    """Segments to walk up from ``a`` and down to ``b``."""
    left, right = F.split(a, "/"), F.split(b, "/")
    shorter = F.least(F.size(left), F.size(right))
    same = F.aggregate(
        F.sequence(F.lit(1), shorter), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.element_at(left, i) == F.element_at(right, i)), i).otherwise(k))
    return (F.size(left) - same) + (F.size(right) - same)


def common_chars(a: Column, b: Column) -> Column:
    """Length of the common leading text of two strings."""
    shorter = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.sequence(F.lit(0), shorter), F.lit(0),
        lambda k, i: F.when(F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i), i).otherwise(k))


def endpoint(url: Column) -> Column:
    """Path of a URL: scheme, host and query removed."""
    return F.substring_index(F.regexp_replace(url, r"^https?://[^/]+", ""), "?", 1)


def line_range(first: Column, last: Column) -> Column:
    """``a`` or ``a–b``."""
    return F.when(first.isNull(), None).when(
        last.isNotNull() & (last != first), F.concat(first.cast("string"), F.lit("–"), last.cast("string"))
    ).otherwise(first.cast("string"))


def human_size(size: Column) -> Column:
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024.0))
            .otherwise(F.format_string("%.1f MB", size / (1024.0 * 1024.0))))


SERVICE_ROOTS = ("services", "apps", "packages", "microservices")                       # fixed values
SERVICE_STOP = ("src", "app", "lib", "main", "tests", "test", "docs", "review")          # fixed values


def service_from_path(path: Column) -> Column:
    """Service a path belongs to: second segment below a service root, else the first unless it is a stop word."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    first = F.element_at(parts, 1)
    return (F.when(F.size(parts) < 2, None)
            .when(first.isin(*SERVICE_ROOTS) & (F.size(parts) > 2), F.try_element_at(parts, F.lit(2)))
            .when(~first.isin(*SERVICE_STOP), first))


SOURCE_DIRS = ("src", "app", "lib", "pkg", "helpers", "utils", "components", "pages", "test", "tests")  # fixed values


def strip_common_root(files: DataFrame, key: str, out: str, group: str = "graph_id") -> DataFrame:
    """Drop the first segment of ``key`` where all files of a graph share it and it is no source folder."""
    first = F.substring_index(F.col(key), "/", 1)
    nested = F.col(key).contains("/")
    roots = files.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.min(first).alias("_lo"), F.max(first).alias("_hi"),
        F.bool_and(nested).alias("_nested"))
    shared = roots.filter((F.col("_n") > 1) & F.col("_nested") & (F.col("_lo") == F.col("_hi"))
                          & (F.col("_lo") != "") & ~F.col("_lo").isin(*SOURCE_DIRS)
                          ).select(group, F.col("_lo").alias("_root"))
    cut = F.when(F.col("_root").isNotNull(), F.substr(F.col(key), F.length("_root") + 2)).otherwise(F.col(key))
    return files.join(shared, group, "left").withColumn(out, cut).drop("_root")
