"""Reading source trees: files, what they are and which to pass over."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import predicates

# Languages by the endings of file names.
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java"}
MANIFESTS = ("go.mod", "package.json", "requirements.txt", "pyproject.toml")


def scan(spark: SparkSession, root: str, repo: str, ignore: list[str] | None = None, read_ignores: bool = True) -> DataFrame:
    """repo, file (below the root), length and content of all files, hidden ones too, but what is ignored.

    ignore: patterns for the root, beside those of the tree's own ignore files, each of which holds for its folder. Spark's reader passes
    hidden files and folders over; tasks list them, one for each folder of the root.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = re.sub(r"^[a-z]+:/*", "", root).strip("/")
    file = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^/*" + re.escape(start) + "/", "")
    rows = raw.select(F.lit(repo).alias("repo"), file.alias("file"), "length", "content").unionByName(_hidden(spark, root, repo))
    rows = rows.where(~F.col("file").rlike(r"(^|/)\.git/"))
    rules = [rule for pattern in ignore or [] if (rule := Ignore.parsed(pattern, ""))]
    if read_ignores:
        found = rows.where(F.col("file").rlike(r"(^|/)\.gitignore$")).select("file", F.col("content").cast("string").alias("text")).collect()  # a few short files
        for f in sorted(found, key=lambda f: (f.file.count("/"), f.file)):
            base = f.file.rpartition("/")[0]
            rules += [rule for line in (f.text or "").splitlines() if (rule := Ignore.parsed(line, base))]
    if rules:
        rows = rows.where(~ignored(F.col("file"), rules))
    return rows.withColumn("content", F.col("content").cast("string"))


def _hidden(spark: SparkSession, root: str, repo: str) -> DataFrame:
    fields = "repo string, file string, length bigint, content binary"
    system, base = fs.FileSystem.from_uri(root)
    at = len(base.rstrip("/")) + 1
    tops = [(f.path[at:], f.is_file) for f in system.get_file_info(fs.FileSelector(base)) if f.path[at:] != ".git"]
    tops = [(name, is_file) for name, is_file in tops if not is_file or name[0] in "._"]
    if not tops:
        return spark.createDataFrame([], fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(root)
        folder = folder.rstrip("/")

        def files(name: str, is_file: bool) -> Iterator[str]:
            if is_file:
                yield name
                return
            for f in store.get_file_info(fs.FileSelector(f"{folder}/{name}", recursive=True)):
                below = f.path[len(folder) + 1 :]
                if f.is_file and re.search(r"(^|/)[._]", below) and not re.search(r"(^|/)\.git/", below):
                    yield below

        for batch in batches:
            for top, is_file in batch.itertuples(index=False):
                for name in files(top, is_file):
                    with store.open_input_file(f"{folder}/{name}") as f:
                        data = f.read()
                    yield pd.DataFrame({"repo": [repo], "file": [name], "length": [len(data)], "content": [data]})

    return spark.createDataFrame(tops, "name string, is_file boolean").repartition("name").mapInPandas(run, fields)


@dataclass(frozen=True)
class Ignore:
    """A line of an ignore file, as an expression that a path below the root must match whole."""

    expression: str
    negated: bool
    folders_only: bool

    @staticmethod
    def parsed(line: str, base: str) -> Ignore | None:
        """None for comments and empty lines. base: the folder of the file that holds the line."""
        text = re.sub(r"(?<!\\)\s+$", "", line)
        if not text or text.startswith("#"):
            return None
        negated = text.startswith("!")
        text = text[negated:].removeprefix("\\") if text[negated : negated + 2] in ("\\#", "\\!") else text[negated:]
        folders_only = text.endswith("/")
        text = text.rstrip("/")
        if not text:
            return None
        rooted = "/" in text
        body = "".join(_spelled(part) for part in re.findall(r"/\*\*/|^\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|[^*?\[\\/]+|.", text.lstrip("/"), re.S))
        before = re.escape(base) + "/" if base else ""
        return Ignore(f"^{before}{'' if rooted else '(?:.*/)?'}{body}$", negated, folders_only)


def _spelled(part: str) -> str:
    """A piece of a pattern as a regular expression."""
    fixed = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}
    if part in fixed:
        return fixed[part]
    if part.strip("*") == "":
        return "[^/]*"
    if part[0] == "[" and part[-1] == "]" and len(part) > 2:
        negated = part[1] in "!^"
        inside = part[1 + negated : -1].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"\&\&").replace("^", r"\^").replace("]", r"\]")
        return f"(?!/)[{'^' if negated else ''}{inside}]"
    return re.escape(part[1:] if part[0] == "\\" and len(part) == 2 else part)


def ignored(file: Column, rules: list[Ignore]) -> Column:
    """Whether ignore rules name a file or a folder above it: of the rules that match a path the last counts, and nothing in an ignored folder comes back."""
    parts = F.split(file, "/")
    n = F.size(parts)

    def verdict(k: Column) -> Column:
        path = F.array_join(F.slice(parts, F.lit(1), k), "/")
        out = None
        for rule in reversed(rules):
            matches = path.rlike(rule.expression) & (k < n) if rule.folders_only else path.rlike(rule.expression)
            out = F.when(matches, F.lit(not rule.negated)) if out is None else out.when(matches, F.lit(not rule.negated))
        return out.otherwise(F.lit(False))

    return F.exists(F.sequence(F.lit(1), n), verdict)


def language(file: Column) -> Column:
    ending = F.lower(F.substring_index(file, ".", -1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.when(F.contains(file, F.lit(".")), ending))


def route(file: Column) -> Column:
    """manifest, proto, infra, code, or null for files that nothing reads."""
    name = F.substring_index(file, "/", -1)
    infra = name.startswith("Dockerfile") | name.rlike(r"\.(ya?ml|gotmpl)$")
    return F.when(name.isin(*MANIFESTS), "manifest").when(name.endswith(".proto"), "proto").when(infra, "infra").when(language(file).isNotNull(), "code")


def routed(files: DataFrame) -> DataFrame:
    """files with route, language, and whether they are of tests or generated."""
    f = F.col("file")
    return files.withColumns({"route": route(f), "language": language(f), "is_test": predicates.test_path(f), "is_generated": predicates.generated_path(f)}).where("route is not null")
