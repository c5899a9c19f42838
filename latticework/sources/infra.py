"""Facts from protocol files, manifests of clusters and images, and package manifests: line tables and windows, no row-wise code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import classify, paths, predicates
from latticework.sources.lines import indent, lines_of, yaml_field

WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet")


def _bare(text: Column) -> Column:
    """A line without the white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _in_file():
    return Window.partitionBy("repo", "file").orderBy("line")


def _so_far():
    return _in_file().rowsBetween(Window.unboundedPreceding, 0)


# ---- proto ----------------------------------------------------------------------------------------------------------------------


def protos(files: DataFrame) -> DataFrame:
    """repo, file, line, package, service, method and name (package.service.method) of every rpc. A service ends at a line that is ``}`` alone."""
    text = _bare(F.col("text"))
    rows = lines_of(files).withColumn("text", F.regexp_replace(text, r"\s*//.*$", ""))
    rows = rows.withColumn("package", F.first(F.nullif(F.regexp_extract("text", r"^package\s+([\w.]+)\s*;", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("repo", "file")))
    opened = F.nullif(F.regexp_extract("text", r"^service\s+(\w+)", 1), F.lit(""))
    mark = F.when(opened.isNotNull(), opened).when(F.col("text") == "}", F.lit(""))
    rows = rows.withColumn("service", F.last(mark, ignorenulls=True).over(_so_far()))
    method = F.regexp_extract("text", r"^(?:service\s+\w+\s*\{\s*)?rpc\s+(\w+)", 1)
    found = rows.where((F.coalesce("service", F.lit("")) != "")).withColumn("method", method).where("method <> ''")
    return found.select("repo", "file", "line", "package", "service", "method", F.concat_ws(".", "package", "service", "method").alias("name"))


def proto_services(files: DataFrame) -> DataFrame:
    """repo, file, package, service_name, fqn and methods, in order."""
    found = protos(files).groupBy("repo", "file", "package", "service").agg(F.array_sort(F.collect_list(F.struct("line", "method"))).alias("m"))
    return found.select("repo", "file", "package", F.col("service").alias("service_name"), F.concat_ws(".", "package", "service").alias("fqn"), F.transform("m", lambda x: x["method"]).alias("methods"))


# ---- cluster manifests ----------------------------------------------------------------------------------------------------------


def yaml_documents(files: DataFrame) -> DataFrame:
    """The lines of YAML files with doc, the number of the document, and kind, its kind."""
    rows = lines_of(files).withColumn("doc", F.sum(F.when(F.col("text").startswith("---"), 1).otherwise(0)).over(_so_far()))
    kind = F.when(indent(F.col("text")) == 0, yaml_field(F.col("text"), "kind"))
    return rows.withColumn("kind", F.first(kind, ignorenulls=True).over(Window.partitionBy("repo", "file", "doc")))


def _document():
    return Window.partitionBy("repo", "file", "doc").orderBy("line")


def env_bindings(files: DataFrame) -> DataFrame:
    """repo, file, line, deployment_name, var_name and value of the variables that workloads set; templates come to their defaults.

    A variable is a ``name:`` in a list that a ``value:`` follows on the next line of text. The workload is the document's first name
    outside of lists.
    """
    rows = yaml_documents(files).where(_bare(F.col("text")) != "")
    text = F.col("text")
    in_list = text.rlike(r"^\s*-\s")
    own = F.first(F.when(~in_list & (indent(text) > 0), yaml_field(text, "name")), ignorenulls=True).over(Window.partitionBy("repo", "file", "doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("deployment_name", own).withColumn("var_name", F.when(in_list, yaml_field(text, "name"))).withColumn("after", F.lead("text").over(_document()))
    value = yaml_field(F.col("after"), "value")
    found = rows.withColumn("value", predicates.template_value(value)).where("var_name is not null and value is not null")
    return found.select("repo", "file", "line", "deployment_name", "var_name", "value", "kind")


def secret_variables(files: DataFrame) -> DataFrame:
    """repo, file, line and var_name of variables that ``valueFrom`` fills."""
    rows = yaml_documents(files).where(_bare(F.col("text")) != "")
    rows = rows.withColumn("var_name", F.when(F.col("text").rlike(r"^\s*-\s"), yaml_field(F.col("text"), "name"))).withColumn("after", F.lead("text").over(_document()))
    return rows.where(F.col("var_name").isNotNull() & yaml_field(F.col("after"), "valueFrom").isNotNull()).select("repo", "file", "line", "var_name")


def container_images(files: DataFrame) -> DataFrame:
    """repo, file, line and image_ref of ``image:`` lines."""
    ref = predicates.template_value(yaml_field(F.col("text"), "image"))
    return yaml_documents(files).withColumn("image_ref", ref).where("image_ref <> ''").select("repo", "file", "line", "image_ref")


def services(files: DataFrame) -> DataFrame:
    """repo, file, name, namespace (``default`` without one), ports and selector of Service documents; line is that of the kind."""
    rows = yaml_documents(files).where("kind = 'Service'").where(_bare(F.col("text")) != "")
    text, depth = F.col("text"), indent(F.col("text"))
    top = F.last(F.when(depth == 0, F.regexp_extract(text, r"^(\w+):", 1)), ignorenulls=True).over(_document().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("top", top).withColumn("inner", F.min(F.when(depth > 0, depth)).over(Window.partitionBy("repo", "file", "doc", "top")))
    inner = F.col("inner")  # how far the keys of a block stand in, whatever the file's step is
    second = F.last(F.when(depth <= inner, F.when(depth == inner, F.regexp_extract(text, r"^\s*(\w+):", 1)).otherwise("")), ignorenulls=True).over(_document().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("second", second)
    pair = F.regexp_extract(text, r"^\s+([\w./-]+):\s*\S", 1)
    entry = F.struct("line", pair.alias("key"), F.regexp_replace(F.regexp_extract(text, r":\s*(\S.*?)\s*$", 1), r"""^["']|["']$""", "").alias("value"))
    selected = F.when((F.col("top") == "spec") & (F.col("second") == "selector") & (depth > inner) & (pair != ""), entry)
    port = F.when(F.col("top") == "spec", paths.port_number(yaml_field(text, "port")))
    meta = lambda f: F.when((F.col("top") == "metadata") & (depth == inner), yaml_field(text, f))
    rows = rows.withColumns({"m_name": meta("name"), "m_space": meta("namespace"), "m_port": port, "m_sel": selected, "at": F.when((depth == 0) & yaml_field(text, "kind").isNotNull(), F.col("line"))})
    found = rows.groupBy("repo", "file", "doc").agg(
        F.first("m_name", ignorenulls=True).alias("name"),
        F.coalesce(F.first("m_space", ignorenulls=True), F.lit("default")).alias("namespace"),
        F.array_sort(F.collect_list(F.when(F.col("m_port").isNotNull(), F.struct("line", "m_port")))).alias("p"),
        F.array_sort(F.collect_list("m_sel")).alias("s"),
        F.min("at").alias("line"),
    )
    last = F.expr("filter(s, (x, i) -> not exists(slice(s, i + 2, size(s)), y -> y.key = x.key))")  # of a key given twice the last counts
    selector = F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))
    return found.where("name is not null").select("repo", "file", "line", "name", "namespace", F.transform("p", lambda x: x["m_port"]).alias("ports"), selector.alias("selector"))


def network_variables(files: DataFrame) -> DataFrame:
    """Network calls that variables with addresses stand for, but those of workflow folders: file, line, net_kind, callee_fqn, address."""
    plain = env_bindings(files).where(~F.col("file").rlike(r"(^|/)\.github/")).where(predicates.network_value(F.col("value")) | predicates.address_variable(F.col("var_name")))
    clean = predicates.without_templates(F.col("value"))
    literal = plain.select("repo", "file", "line", classify.address_kind(F.col("value")).alias("net_kind"), F.concat(F.lit("env:"), "var_name").alias("callee_fqn"), F.to_json(F.struct(F.struct(clean.alias("value")).alias("Literal"))).alias("address_source"))
    hidden = secret_variables(files).where(~F.col("file").rlike(r"(^|/)\.github/")).where(predicates.address_variable(F.col("var_name")))
    dynamic = hidden.select("repo", "file", "line", F.lit("unknown").alias("net_kind"), F.concat(F.lit("env:"), "var_name").alias("callee_fqn"), F.to_json(F.struct(F.struct(F.concat(F.lit("secret:"), "var_name").alias("hint")).alias("Dynamic"))).alias("address_source"))
    return literal.unionByName(dynamic)


# ---- images ---------------------------------------------------------------------------------------------------------------------


def dockerfiles(files: DataFrame) -> DataFrame:
    """repo, file, line, image_ref of each FROM but ``scratch``, with the file's exposed ports, variables, entry point and command."""
    rows = lines_of(files).withColumn("text", _bare(F.col("text")))
    word = F.upper(F.regexp_extract("text", r"^(\w+)\s", 1))
    rest = F.regexp_extract("text", r"^\w+\s+(.*)$", 1)
    rows = rows.withColumn("word", word).withColumn("rest", rest)
    ports = F.transform(F.split("rest", r"\s+"), lambda p: paths.port_number(F.substring_index(p, "/", 1)))
    old_style = F.array(F.struct(F.regexp_extract("rest", r"^(\S+)", 1).alias("k"), F.regexp_extract("rest", r"^\S+\s+(.*)$", 1).alias("v")))
    pairs = F.transform(F.regexp_extract_all("rest", F.lit(r"""(\w+=(?:"[^"]*"|\S*))"""), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.regexp_extract(p, r"(?s)=(.*)$", 1), r'^"|"$', "").alias("v")))
    env = F.when(F.regexp_extract("rest", r"^(\w+=)", 1) != "", pairs).otherwise(old_style)
    of_file = rows.groupBy("repo", "file").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("word") == "EXPOSE", F.filter(ports, lambda p: p.isNotNull()))))).alias("exposed_ports"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("word") == "ENV", F.struct("line", env.alias("e"))))), lambda x: x["e"])).alias("env_defaults"),
        F.max_by(F.when(F.col("word") == "ENTRYPOINT", F.col("rest")), F.when(F.col("word") == "ENTRYPOINT", F.col("line"))).alias("entrypoint"),
        F.max_by(F.when(F.col("word") == "CMD", F.col("rest")), F.when(F.col("word") == "CMD", F.col("line"))).alias("cmd"),
    )
    bases = rows.where("word = 'FROM'").withColumn("image_ref", F.regexp_extract("rest", r"^(?:--\S+\s+)*(\S+)", 1)).where("lower(image_ref) <> 'scratch'")
    return bases.select("repo", "file", "line", "image_ref").join(of_file, ["repo", "file"])


# ---- packages -------------------------------------------------------------------------------------------------------------------


def dependencies(files: DataFrame) -> DataFrame:
    """repo, file, name, version and is_dev of what manifests require."""
    base = F.substring_index("file", "/", -1)
    kept = ["repo", "file", "name", "version", "is_dev"]
    go = lines_of(files.where(base == "go.mod")).withColumn("text", _bare(F.col("text")))
    in_block = F.last(F.when(F.col("text").rlike(r"^require\s*\("), True).when(F.col("text") == ")", False), ignorenulls=True).over(_so_far())
    spec = r"^(?:require\s+)?([^\s()]+)\s+(v\S+)"
    go = go.withColumn("open", F.coalesce(in_block, F.lit(False))).where((F.col("open") | F.col("text").startswith("require ")) & (F.regexp_extract("text", spec, 1) != ""))
    go = go.select("repo", "file", F.regexp_extract("text", spec, 1).alias("name"), F.regexp_extract("text", spec, 2).alias("version"), F.lit(False).alias("is_dev"))
    node = files.where(base == "package.json").select("repo", "file", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    listed = [node.select("repo", "file", F.explode(f"j.{k}").alias("name", "version"), F.lit(dev).alias("is_dev")) for k, dev in (("dependencies", False), ("devDependencies", True))]
    req = lines_of(files.where(base == "requirements.txt")).withColumn("text", F.trim(F.regexp_replace("text", r"\s*#.*$", ""))).where(~F.col("text").startswith("-"))
    python = _requirements(req.select("repo", "file", "text", F.lit(False).alias("is_dev")))
    toml = lines_of(files.where(base == "pyproject.toml")).withColumn("text", _bare(F.col("text")))
    table = F.last(F.when(F.col("text").rlike(r"^\["), F.regexp_extract("text", r"^\[+([^\]]+)\]+", 1)), ignorenulls=True).over(_so_far())
    toml = toml.withColumn("table", table)
    key = F.last(F.when(F.col("text").rlike(r"^[\w.-]+\s*=\s*\["), F.regexp_extract("text", r"^([\w.-]+)", 1)).when(F.col("text").startswith("]"), ""), ignorenulls=True).over(_so_far())
    quoted = toml.withColumn("key", key).withColumn("item", F.explode(F.regexp_extract_all("text", F.lit(r"""["']([A-Za-z0-9][^"']*)["']"""), F.lit(1))))
    main = ((F.col("table") == "project") & (F.col("key") == "dependencies")) | (F.col("table") == "project.optional-dependencies")
    project = _requirements(quoted.where(main).select("repo", "file", F.col("item").alias("text"), (F.col("table") != "project").alias("is_dev")))
    poetry = toml.where(F.col("table").rlike(r"^tool\.poetry\.(group\.\w+\.|dev-)?dependencies$")).withColumn("name", F.regexp_extract("text", r"^([A-Za-z0-9_.-]+)\s*=", 1)).where("name not in ('', 'python')")
    poetry = poetry.select("repo", "file", "name", F.regexp_extract("text", r"""["']([^"']*)["']""", 1).alias("version"), (F.col("table") != "tool.poetry.dependencies").alias("is_dev"))
    out = go
    for df in (*listed, python, project, poetry):
        out = out.unionByName(df.select(kept))
    return out.select(kept)


def _requirements(rows: DataFrame) -> DataFrame:
    """name and version of requirement texts; extras and markers are left out."""
    clean = F.regexp_replace(F.regexp_replace("text", r"\s*;.*$", ""), r"\[[^\]]*\]", "")
    name = F.regexp_extract(clean, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return rows.select("repo", "file", name.alias("name"), F.trim(F.regexp_extract(clean, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(.*)$", 1)).alias("version"), "is_dev").where("name <> ''")
