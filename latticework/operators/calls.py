"""Network calls: deduplication, comparison of snapshots, reports and searches for a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import classify, predicates
from latticework.model import CONFIDENCE_RANK

CALL_KEY = ["file", "line", "callee_fqn"]


def rank_of(confidence: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv))
    return F.coalesce(F.element_at(ranks, confidence), F.lit(0))


def dedup(calls: DataFrame) -> DataFrame:
    """One call for each (file, line): of the highest confidence, the earliest of equals."""
    best = Window.partitionBy("file", "line").orderBy(rank_of(F.col("confidence")).desc(), "seq")
    return calls.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def first_wins(calls: DataFrame, others: DataFrame) -> DataFrame:
    """calls, and what others have at places (file, line) that calls lack; the first by seq at each place."""
    early = Window.partitionBy("file", "line").orderBy("turn", "seq")
    both = calls.withColumn("turn", F.lit(0)).unionByName(others.withColumn("turn", F.lit(1)))
    return both.withColumn("place", F.row_number().over(early)).where("place = 1").drop("place", "turn")


def without_noise(calls: DataFrame) -> DataFrame:
    return calls.where(~predicates.noise_path(F.col("file")))


def latest(calls: DataFrame, key: list[str]) -> DataFrame:
    """The last row by seq of each key."""
    others = [c for c in calls.columns if c not in key]
    last = calls.groupBy(*key).agg(F.max_by(F.struct(*others), "seq").alias("last"))
    return last.select(*key, "last.*")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (added, removed or changed), and the kinds and sources before and after, of calls keyed by file, line and callee."""
    a = latest(before, CALL_KEY).select(*CALL_KEY, F.struct("net_kind", "address_source").alias("before"))
    b = latest(after, CALL_KEY).select(*CALL_KEY, F.struct("net_kind", "address_source").alias("after"))
    both = a.join(b, CALL_KEY, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    key = F.concat_ws(":", "file", F.col("line").cast("string"), "callee_fqn")
    return both.select(key.alias("key"), change.alias("change"), "before", "after").where("change is not null")


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def key_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key and change by the sets of keys alone."""
    a, b = (df.select(*CALL_KEY).distinct() for df in (before, after))
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def graph_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The keys of nodes or edges that were added or removed."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added")).unionByName(
        before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    )


def layered(base: DataFrame, removed: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """A base snapshot without the removed keys, under the added rows, which replace rows of their key."""
    return base.join(removed.select(key).unionByName(added.select(key)).distinct(), key, "left_anti").unionByName(added)


# ---- reports --------------------------------------------------------------------------------------------------------------------


def summary(calls: DataFrame) -> DataFrame:
    """kind (as shown), direction and n, in order."""
    shown = calls.select(classify.kind_label(F.col("net_kind")).alias("kind"), classify.direction(F.col("net_kind")).alias("direction"))
    return shown.groupBy("kind", "direction").agg(F.count("*").alias("n")).orderBy("kind", "direction")


def remote_kept(remote: DataFrame, local: DataFrame, include_all: bool = False) -> DataFrame:
    """Remote calls (with env_var) whose variable some local call has too; all of them if asked for."""
    if include_all:
        return remote
    return remote.join(local.where("env_var is not null").select("env_var").distinct(), "env_var", "left_semi").select(remote.columns)


def fix_summary(calls: DataFrame) -> DataFrame:
    """One row: total, resolved, heuristic and dynamic calls."""
    return calls.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") != "heuristic").alias("resolved"),
        F.count_if(F.col("confidence") == "heuristic").alias("heuristic"),
        F.count_if(F.col("address_source").startswith('{"Dynamic"')).alias("dynamic"),
    )


def callee_templates(calls: DataFrame) -> DataFrame:
    """One row for each callee that no rule knows, with its first place: what a rule file starts from."""
    unknown = calls.where("confidence = 'heuristic'")
    return unknown.groupBy("callee_fqn").agg(F.min(F.struct("file", "line")).alias("at"), F.count("*").alias("n")).select("callee_fqn", "at.file", "at.line", "n")


def explain(calls: DataFrame, target: str, chain: Column | None = None) -> DataFrame:
    """Calls whose callee, file or provenance mentions the target."""
    where = F.contains("callee_fqn", F.lit(target)) | F.contains("file", F.lit(target)) | F.contains(chain if chain is not None else F.col("address_source"), F.lit(target))
    return calls.where(where)


def connects_report(edges: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Connects edges with their symbol's place and kind; the call at the place, the last by seq, tells more where there is one.

    edges: src, dst of Connects; nodes: id, name, file, line; calls: file, line, net_kind, confidence, seq.
    """
    at = nodes.select(F.col("id").alias("src"), F.col("name").alias("symbol"), "file", "line")
    to = nodes.select(F.col("id").alias("dst"), F.col("name").alias("target"))
    known = latest(calls.select("file", "line", "net_kind", "confidence", "seq"), ["file", "line"]).drop("seq")
    rows = edges.select("src", "dst").join(at, "src").join(to, "dst").join(known, ["file", "line"], "left")
    kind = F.coalesce("net_kind", classify.resource_kind(F.col("target")))
    return rows.select("file", "line", "symbol", "target", kind.alias("kind"), classify.direction(kind).alias("direction"), F.coalesce("confidence", F.lit("graph")).alias("confidence"))


def taint_only(calls: DataFrame, covered: DataFrame) -> DataFrame:
    """Calls at places (file, line) that no row of covered has."""
    return calls.join(covered.select("file", "line").distinct(), ["file", "line"], "left_anti")


def service_members(nodes: DataFrame, ancestors: DataFrame, wanted: str) -> DataFrame:
    """id of nodes whose own name, or that of a deployable or module above them, holds the wanted text. ancestors: id, ancestor."""
    own = nodes.where(F.contains(F.lower("name"), F.lit(wanted.lower()))).select("id")
    named = nodes.where(F.col("kind").isin(1, 2) & F.contains(F.lower("name"), F.lit(wanted.lower()))).select(F.col("id").alias("ancestor"))
    return own.union(ancestors.join(named, "ancestor", "left_semi").select("id")).distinct()


# ---- outbound calls and endpoints -----------------------------------------------------------------------------------------------

# Services too general to be told by a URL.
GENERIC_SERVICES = ("main", "server", "handler", "service", "app", "http", "grpc", "ws")


def outbound_matches(outbounds: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls and endpoints of different repos that meet by path, by gRPC service or by URL; the first of these ways counts.

    outbounds: file, line, callee, address_hint, repo; endpoints: file, line, path, service, repo. A path that stands in a hint or callee
    starts at one of its slashes, a service's name at one of its positions: outbounds list those beginnings of each endpoint length, so
    all three ways are equi-joins and no pair is made that does not match.
    """
    ready = F.when(predicates.noise_path(F.col("file")), False).otherwise(True)
    out = outbounds.select("file", "line", "callee", "address_hint", "repo", ready.alias("plain")).withColumn("out_id", F.monotonically_increasing_id())
    ep = endpoints.select(*(F.col(c).alias(f"e_{c}") for c in ("file", "line", "path", "service", "repo")), F.when(predicates.noise_path(F.col("file")), False).otherwise(True).alias("e_plain"))
    apart = predicates.cross_repo(F.col("repo"), F.col("e_repo"))
    tested = ep.where(F.col("e_plain") & (F.length("e_path") >= 3) & ~F.col("e_path").isin("*", "websocket") & F.startswith("e_path", F.lit("/")))
    by_path = _contained(out.where("plain"), tested, F.array("address_hint", "callee"), F.col("e_path"), "/").where(apart)
    o_svc = classify.grpc_service(F.col("callee"))
    e_svc = F.coalesce(classify.grpc_service(F.col("e_service")), classify.grpc_service(F.col("e_path")))
    by_service = out.withColumn("svc", F.lower(o_svc)).join(ep.withColumn("e_svc", F.lower(e_svc)), F.col("svc") == F.col("e_svc")).where(apart).drop("svc", "e_svc")
    key = lambda c: F.when(F.startswith(c, F.lit("grpc:")), F.lower(F.substring(c, 6, 1 << 20)))
    by_key = out.withColumn("k", key("address_hint")).join(ep.withColumn("e_k", key("e_path")), F.col("k") == F.col("e_k")).where(apart).drop("k", "e_k")
    low = F.lower("e_service")
    hosts = ep.where(F.col("e_plain") & (F.length(low) >= 4) & ~low.isin(*GENERIC_SERVICES) & ~F.col("e_path").isin("/", "*"))
    hinted = out.where(F.col("plain") & (F.col("address_hint") != ""))
    by_url = _contained(hinted, hosts.where(F.length(low) > 6), F.array(F.lower("address_hint")), low).where(apart)
    hint = F.lower("address_hint")
    host = F.substring_index(F.substring_index(F.substring_index(hint, "://", -1), ":", 1), "/", 1)
    bare = F.substring_index(F.substring_index(host, ".svc.cluster.local", 1), ".", 1)
    cluster = hinted.where(F.contains(hint, F.lit(".svc.cluster.local"))).withColumn("bare", bare)
    named = _contained(hosts.withColumn("svc", low), cluster, F.array("svc"), F.col("bare")).where(apart).drop("svc", "bare")
    ways = (by_path, 1, "path"), (by_service, 2, "grpc"), (by_key, 2, "grpc"), (by_url, 3, "url"), (named, 3, "url")
    columns = ["out_id", "file", "line", "callee", "repo", "e_file", "e_line", "e_path", "e_service", "e_repo"]
    found = None
    for df, order, way in ways:
        df = df.select(*columns, F.lit(order).alias("order"), F.lit(way).alias("match_type"))
        found = df if found is None else found.unionByName(df)
    pair = [c for c in columns if c not in ("callee",)]
    best = found.groupBy(*pair).agg(F.min(F.struct("order", "match_type", "callee")).alias("best"))
    place = ["file", "line", "e_file", "e_line", "match_type"]
    one = best.select(*pair, "best.match_type", "best.callee").groupBy(*place).agg(F.min(F.struct("repo", "callee", "e_path", "e_repo")).alias("x"))
    return one.select(*place, "x.*")


def _contained(texts: DataFrame, parts: DataFrame, inside: Column, part: Column, sign: str = "") -> DataFrame:
    """Rows of texts and parts where the part stands in one of the texts: by substrings of the lengths that parts have, an equi-join.

    sign: what every part begins with, so that only substrings there are listed. Each distinct text is cut once, and only substrings that
    are parts go on. The distinct lengths, a few, come to the driver; an empty part, which stands in everything, stands in nothing here.
    """
    keyed = parts.withColumn("part_key", part).where("part_key is not null")
    lengths = sorted(r[0] for r in keyed.select(F.length("part_key")).distinct().collect() if r[0]) or [1]
    cut = texts.select(F.explode(F.array_distinct(inside)).alias("text_key")).where("text_key is not null").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text_key") - lengths[0] + 1))
    if sign:
        starts = F.filter(starts, lambda k: F.substring(F.col("text_key"), k, F.lit(len(sign))) == sign)
    subs = cut.select("text_key", F.explode(starts).alias("k")).select("text_key", "k", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    subs = subs.where("k + n - 1 <= length(text_key)").select("text_key", F.expr("substring(text_key, k, n)").alias("part_key"))
    met = subs.join(keyed.select("part_key").distinct(), "part_key", "left_semi").distinct()
    found = texts.withColumn("text_key", F.explode(F.array_distinct(inside))).join(met, "text_key").drop("text_key").dropDuplicates()
    return found.join(keyed, "part_key").drop("part_key")
