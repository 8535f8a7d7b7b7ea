"""Batch control: inputs and outputs, argument checks, jobs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped_brackets(rows: DataFrame, col: str = "path") -> DataFrame:
    """Brackets made literal for globbing, in one pass."""
    return rows.withColumn("escaped", F.regexp_replace(col, r"([\[\]])", "[$1]"))


def input_output_plan(files: DataFrame, directory: str, pattern: str = "*.svg") -> DataFrame:
    """(findex, ord, path, output): the first of each path, in order, with the
    stem put into the pattern."""
    first = files.groupBy("path").agg(F.min("ord").alias("ord"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    head, _, tail = pattern.partition("*")
    return first.select("ord", "path", F.concat(F.lit(f"{directory}/{head}"), stem, F.lit(tail)).alias("output"))


def collisions(plan: DataFrame) -> DataFrame:
    """Outputs that more than one input would write."""
    return plan.groupBy("output").agg(F.count("*").alias("n_inputs"), F.min("ord").alias("first_ord")).where("n_inputs > 1")


def _pattern(arg: Column, brackets: bool) -> Column:
    """A wildcard path as a regular expression: * and ? stay within a folder and
    don't begin a hidden name; brackets are letters unless they are classes."""
    plain = F.regexp_replace(arg, r"([.+^$(){}|\\])", r"\\$1")
    if brackets:
        plain = F.regexp_replace(plain, r"\[!", "[^")
    else:
        plain = F.regexp_replace(plain, r"([\[\]])", r"\\$1")
    hidden = F.regexp_replace(plain, r"(^|/)(?=[*?])", r"$1(?!\\.)")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(hidden, r"\*", "[^/]*"), r"(?<!\()\?", "[^/]"), F.lit("$"))


def compared_inputs(args: DataFrame, listing: DataFrame, brackets: bool = False) -> DataFrame:
    """(ord, arg, pattern, path): the listed files (path) that each of the arguments
    with wildcards (ord, arg) is compared with.

    An argument meets files of its folder only, or, if the folder has wildcards, files
    at its depth, and of these the ones that begin with its letters before the first
    wildcard: an equi-join on both.  A path goes into it once for each length
    of such beginnings, of which there are few.
    """
    marks = _marks(brackets)
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    depth = lambda c: F.concat(F.lit("#"), F.size(F.split(c, "/")).cast("string"))
    wild = args.where(F.col("arg").rlike(marks)).withColumn("begin", F.regexp_extract("arg", f"(?s)^(.*?){marks}", 1))
    wild = wild.withColumn("at", F.when(folder(F.col("arg")).rlike(marks), depth(F.col("arg"))).otherwise(folder(F.col("arg"))))
    lengths = wild.select(F.length("begin").alias("n")).distinct()
    each = listing.join(F.broadcast(lengths), F.length("path") >= F.col("n")).withColumn("begin", F.expr("substr(path, 1, n)"))
    each = each.withColumn("at", F.explode(F.array(folder(F.col("path")), depth(F.col("path"))))).select("at", "begin", "path")
    return each.join(wild.withColumn("pattern", _pattern(F.col("arg"), brackets)), ["at", "begin"]).select("ord", "arg", "pattern", "path")


def _marks(brackets: bool) -> str:
    return r"[*?\[]" if brackets else "[*?]"


def expanded_inputs(args: DataFrame, listing: DataFrame, brackets: bool = False, missing: bool = True, duplicates: bool = False) -> DataFrame:
    """(ord, path): the files that arguments (ord, arg) name, of those listed (path).

    Arguments with * or ? take the listed files that match, others themselves;
    without ``missing`` only if they are listed.  With ``brackets`` these are
    character classes.  Of a file that comes several times the first counts,
    unless ``duplicates``.  Arguments that are said several times are compared once.
    """
    files = listing.select("path").distinct()
    first = args.groupBy("arg").agg(F.min("ord").alias("ord"))
    found = compared_inputs(first, files, brackets).where(F.rlike("path", "pattern"))
    if duplicates:
        found = found.drop("ord").join(args.select("ord", "arg"), "arg")
    plain = (args if duplicates else first).where(~F.col("arg").rlike(_marks(brackets))).select("ord", F.col("arg").alias("path"))
    found = found.select("ord", "path").unionByName(plain if missing else plain.join(files, "path", "left_semi"))
    return found if duplicates else found.groupBy("path").agg(F.min("ord").alias("ord")).select("ord", "path")


def absolute(rows: DataFrame, root: str, col: str = "path") -> DataFrame:
    """``rows`` with ``absolute``: the path from the root, without . and .. parts."""
    whole = F.when(F.col(col).startswith("/"), F.col(col)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(col)))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return rows.withColumn("absolute", F.concat(F.lit("/"), F.array_join(folded, "/")))


def argument_status(rows: DataFrame, low: float, high: float | None, kind: str = "float") -> DataFrame:
    """``status`` of a text argument: ok, not of its kind (int or float), or out of range."""
    n = F.col("value").try_cast("double")
    if kind == "int":
        n = F.when(F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$"), n)
    name = {"int": "an integer", "float": "a number"}[kind]
    inside = (n >= low) & (n <= high) if high is not None else n >= low
    limits = f"between {low:g} and {high:g}" if high is not None else f"{low:g} or greater"
    return rows.withColumn("status", F.when(n.isNull(), f"must be {name}").when(inside, "ok").otherwise(f"must be {limits}"))


#: Options of a parallel run with kind, least, most, default and choices (fixed values).
PARALLEL = [
    ("colors", "int", 0.0, 256.0, None, None),
    ("quantization", "choice", None, None, "mc", "mc,as,nq"),
    ("remap", "text", None, None, None, None),
    ("prescale", "float", 0.0, None, "2", None),
    ("despeckle", "int", 0.0, None, "2", None),
    ("smoothcorners", "float", 0.0, 1.334, "1.0", None),
    ("optimizepaths", "float", 0.0, 5.0, "0.2", None),
    ("cores", "int", 0.0, None, None, None),
    ("stack", "flag", None, None, "false", None),
    ("background", "flag", None, None, "false", None),
    ("floydsteinberg", "flag", None, None, "false", None),
    ("riemersma", "flag", None, None, "false", None),
]
#: A run that goes image by image has no cores, scales by 1 unless told otherwise and
#: takes the background as a colour (fixed values).
SEQUENTIAL = [{"prescale": ("prescale", "float", 0.1, None, "1.0", None), "background": ("background", "text", None, None, None, None)}.get(o[0], o) for o in PARALLEL if o[0] != "cores"]
#: Of each of these pairs a run may set one; of the first it must.
EXCLUSIVE = [("colors", "remap"), ("floydsteinberg", "riemersma")]


def option_values(given: DataFrame, sequential: bool = True) -> DataFrame:
    """(run_id, option, value, status) for every option of every run of (run_id,
    option, value): what is given or the default, and what is wrong with it.

    Runs go image by image unless they are said to be parallel.  The last value of an option counts (order: ``ord``); an option that does not
    exist has the status ``unknown``.  The table of options is one of a dozen rows.
    """
    spark = given.sparkSession
    known = spark.createDataFrame(SEQUENTIAL if sequential else PARALLEL, "option string, kind string, low double, high double, default string, choices string")
    last = given.groupBy("run_id", "option").agg(F.max_by("value", "ord").alias("value"))
    wanted = given.select("run_id").distinct().crossJoin(F.broadcast(known))
    both = wanted.join(last, ["run_id", "option"], "full")
    n = F.when((F.col("kind") != "int") | F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.col("value").try_cast("double"))
    numeric = F.col("kind").isin("int", "float")
    limits = F.when(F.col("high").isNull(), F.concat(F.format_string("%.3f", "low"), F.lit(" or greater"))).otherwise(F.concat(F.lit("between "), F.format_string("%.3f", "low"), F.lit(" and "), F.format_string("%.3f", "high")))
    status = (
        F.when(F.col("kind").isNull(), "unknown")
        .when(F.col("value").isNull(), "default")
        .when(numeric & n.isNull(), F.concat(F.lit("must be "), F.when(F.col("kind") == "int", "an integer").otherwise("a number")))
        .when(numeric & ((n < F.col("low")) | (n > F.coalesce("high", n))), F.concat(F.lit("must be "), limits))
        .when((F.col("kind") == "choice") & ~F.array_contains(F.split("choices", ","), F.col("value")), F.concat(F.lit("must be one of "), F.col("choices")))
        .when((F.col("kind") == "flag") & ~F.col("value").isin("true", "false"), "must be true or false")
        .otherwise("ok")
    )
    return both.select("run_id", "option", F.coalesce("value", "default").alias("value"), status.alias("status"))


def exclusive_errors(given: DataFrame) -> DataFrame:
    """(run_id, error): runs that set both options of a pair, or neither of the
    one that must be set."""
    seen = given.groupBy("run_id").agg(F.collect_set("option").alias("o"))
    has = lambda name: F.array_contains("o", name)
    errors = [F.when(has(a) & has(b), F.lit(f"{b} not allowed with {a}")) for a, b in EXCLUSIVE] + [F.when(~has(EXCLUSIVE[0][0]) & ~has(EXCLUSIVE[0][1]), F.lit(f"one of {EXCLUSIVE[0][0]} and {EXCLUSIVE[0][1]} is required"))]
    return seen.select("run_id", F.explode(F.array_compact(F.array(*errors))).alias("error"))


def option_errors(options: DataFrame) -> DataFrame:
    """``error`` of an option set: several inputs need a star in the output
    pattern, and Riemersma dithering goes with adaptive subdivision or a remap."""
    error = (
        F.when((F.col("n_inputs") > 1) & (F.instr("output", "*") == 0), "output needs * for several inputs")
        .when((F.col("dither") == "riemersma") & (F.col("quantization") != "as") & ~F.col("remap"), "riemersma needs as or remap")
    )
    return options.withColumn("error", error)


def colour_jobs(files: DataFrame, palettes: DataFrame) -> DataFrame:
    """A job for each file and colour; the index is the place in the palette."""
    return files.join(palettes, "image_id").select("findex", "image_id", "cindex", "color")


def layer_completion(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("findex").agg(F.bool_and("done").alias("all_done"), F.count("*").alias("n_layers"))


def progress(jobs: DataFrame) -> DataFrame:
    """One row: done, total and percent to one decimal."""
    return jobs.agg(F.count_if("done").alias("n_done"), F.count("*").alias("n_total")).withColumn("percent", F.round(F.try_divide(F.col("n_done") * F.lit(100.0), F.col("n_total")), 1))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two numbered tables (n) side by side, up to the shorter one."""
    return left.join(right, "n")
