"""Portfolio analytics over the platform's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.components import stage_table


def case_counts(cases: DataFrame, documents: DataFrame, results: DataFrame) -> DataFrame:
    """cases with n_docs and n_results, 0 if none: two aggregates before the joins."""
    d = documents.groupBy("case_id").agg(F.count("*").alias("n_docs"))
    r = results.groupBy("case_id").agg(F.count("*").alias("n_results"))
    return cases.join(d, "case_id", "left").join(r, "case_id", "left").na.fill(0, ["n_docs", "n_results"])


def owned_cases(cases: DataFrame, documents: DataFrame, results: DataFrame) -> DataFrame:
    """Cases that aren't deleted, newest first, with their counts."""
    return case_counts(cases.filter("status <> 'deleted'"), documents, results).orderBy(F.desc("updated_at"), "case_id")


def shared_cases(shares: DataFrame, cases: DataFrame, documents: DataFrame, results: DataFrame) -> DataFrame:
    kept = cases.filter("status <> 'deleted'").join(shares, "case_id")
    return case_counts(kept, documents, results).orderBy(F.desc("updated_at"), "case_id", "user_id")


def accessible(cases: DataFrame, shares: DataFrame) -> DataFrame:
    """(case_id, user_id) pairs that may read a case: its owner and those it is shared with."""
    own = cases.select("case_id", F.col("owner_id").alias("user_id"))
    return own.unionByName(shares.select("case_id", "user_id")).distinct()


def readable(requests: DataFrame, pairs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Requests (case_id, user_id) of a permitted pair; with users also those of every admin, whatever the case."""
    allowed = requests.join(pairs.select("case_id", "user_id").distinct().withColumn("_cw_pair", F.lit(True)), ["case_id", "user_id"], "left")
    if users is None:
        return allowed.filter("_cw_pair").drop("_cw_pair")
    admins = users.filter("role = 'admin'").select("user_id").distinct().withColumn("_cw_admin", F.lit(True))
    return allowed.join(admins, "user_id", "left").filter("_cw_pair or _cw_admin").select(*requests.columns)


def case_documents(documents: DataFrame, case_id) -> DataFrame:
    return documents.filter(F.col("case_id") == case_id).orderBy(F.desc("created_at"), "document_id")


def platform_counters(users: DataFrame, cases: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row: users, admins, cases, active subscriptions (each side is a single aggregate row)."""
    u = users.agg(F.count("*").alias("n_users"), F.count_if(F.col("role") == "admin").alias("n_admins"))
    c = cases.agg(F.count("*").alias("n_cases"))
    s = subscriptions.agg(F.count_if(F.col("status") == "active").alias("n_active"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(u).join(one(c), "_one").join(one(s), "_one").drop("_one")


def recent_logins(users: DataFrame, *, keep: int = 10) -> DataFrame:
    return users.filter("last_login is not null").orderBy(F.desc("last_login"), "user_id").limit(keep)


def user_listing(users: DataFrame) -> DataFrame:
    return users.orderBy(F.desc("created_at"), "user_id")


def active_sessions(sessions: DataFrame, now: Column, current: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now).withColumn("is_current", F.col("session_id") == current)


def current_subscription(subscriptions: DataFrame, now: Column) -> DataFrame:
    """The active subscription of each user that expires last, and whether it has expired."""
    w = Window.partitionBy("user_id").orderBy(F.desc("expires_at"), "subscription_id")
    last = subscriptions.filter("status = 'active'").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.withColumn("expired", F.col("expires_at") < now)


def renewed(start: Column, months: int = 1) -> Column:
    """The date a month later, clamped to the month's last day."""
    return F.add_months(start, months)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Upsert: the newest row of each key; at one time the new table wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def fingerprint(*parts: str) -> Column:
    return F.sha2(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)), 256)


def new_transactions(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Transactions (with fingerprint) that aren't known yet, each once."""
    return incoming.dropDuplicates(["fingerprint"]).join(known.select("fingerprint"), "fingerprint", "left_anti")


def summary_statistics(nodes: DataFrame, edges: DataFrame, findings: DataFrame, mentions: DataFrame, profiles: DataFrame, *, top: int = 10) -> DataFrame:
    """One row a case: nodes (and by group), edges, findings by category, entities and their mentions, the `top` most
    connected nodes with their degrees, and three fields of the profile (null without one)."""
    from casewright.operators.graph import group_counts, most_connected

    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    total = mentions.groupBy("case_id").agg(F.count("*").alias("n_entities"), F.sum("mentions").alias("n_mentions"))
    groups = group_counts(nodes).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "n")))).alias("groups"))
    linked = most_connected(edges, keep=top).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "degree"))), lambda x: F.struct(x["id"].alias("id"), x["degree"].alias("degree"))).alias("top_connected"))
    found = findings.groupBy("case_id").agg(F.count("*").alias("n_findings"), *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("inconsistencias", "incongruencias", "declaracion_vs_evidencia")))
    out = count(nodes, "n_nodes").join(count(edges, "n_edges"), "case_id", "full").join(found, "case_id", "full").join(total, "case_id", "full").na.fill(0)
    profile = profiles.select("case_id", "jurisdiccion", "tipo_caso", "subtipo_caso")
    return out.join(groups, "case_id", "left").join(linked, "case_id", "left").join(profile, "case_id", "left")


def entity_report(entities: DataFrame, mentions: DataFrame, *, keep: int = 15) -> DataFrame:
    """(case_id, rank, name, mentions, n_files): the most mentioned entities (case_id, name, mentions) of a case, and in
    how many files of mentions (case_id, name, file) they are."""
    w = Window.partitionBy("case_id").orderBy(F.desc("mentions"), "name")
    top = entities.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("case_id", "rank", "name", "mentions")
    files = mentions.join(top.select("case_id", "name"), ["case_id", "name"], "left_semi").groupBy("case_id", "name").agg(F.count_distinct("file").cast("int").alias("n_files"))
    return top.join(files, ["case_id", "name"], "left").select("case_id", "rank", "name", "mentions", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def traced_entities(traces: DataFrame, aliases: DataFrame, *, keep: int = 10) -> DataFrame:
    """(case_id, rank, name, parts): the first traced entities of a case by alias, and which parts of a trace they have."""
    w = Window.partitionBy("case_id").orderBy("alias")
    first = traces.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    has = lambda c: F.when(F.size(c) > 0, F.lit(c))
    parts = F.concat_ws(", ", F.when(F.col("role").isNotNull(), F.lit("role")), has("actions"), has("people"), has("vehicles"), has("locations"))
    named = first.join(aliases.select("case_id", "alias", "real_name"), ["case_id", "alias"], "left")
    return named.select("case_id", "rank", F.coalesce("real_name", "alias").alias("name"), parts.alias("parts"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(case_id, data_hash): independent of row order, from sums of row hashes, so nothing is gathered per case."""
    h = F.xxhash64(*columns)
    parts = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("a"), F.bit_xor(h).alias("b"))
    return parts.select("case_id", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("data_hash"))


def stale_cases(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Cases whose content hash the summary cache doesn't hold."""
    return current.join(cached.select("case_id", "data_hash"), ["case_id", "data_hash"], "left_anti")


def cached_summaries(rows: DataFrame, columns: list[str], compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(case_id, …, data_hash): the summary of every case of rows, read from the cache at `path` where its content is as
    it was, and computed for the others alone.

    compute gets those (case_id) and gives one row each; columns are what a summary depends on. The cache is a folder of
    numbered versions: a new one holds what still holds and what is fresh, and is complete before it is read; when
    nothing has changed none is written. Runs when called.
    """
    spark = rows.sparkSession
    now = stage_table(content_hash(rows, columns), "hashes")
    try:
        known = spark.read.parquet(path)
        version = known.agg(F.max("version")).first()[0]
        known = known.filter(F.col("version") == version).drop("version")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known, version = None, 0
    if known is None:
        out = compute(now.select("case_id")).join(now, "case_id")
    else:
        stale = stage_table(stale_cases(now, known), "stale")
        kept = known.join(now, ["case_id", "data_hash"], "left_semi")
        if stale.isEmpty() and kept.count() == known.count():
            return known
        out = kept.unionByName(compute(stale.select("case_id")).join(stale, "case_id"))
    out.write.parquet(f"{path}/version={version + 1}")
    return spark.read.parquet(f"{path}/version={version + 1}")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the non-null new values; status may be set to deleted (a soft delete)."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    return joined.select(*rows.columns)
