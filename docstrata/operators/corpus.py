"""Crawl decisions, link frontiers, queue states, access rules and incremental synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut

# Messages and codes that decide whether something is tried again.
RETRY = "(?i)timeout|502|503|fetch"
FINAL_CODES = ("23505", "42501", "42P01")
FINAL_MESSAGES = ("permission denied", "does not exist", "already exists", "invalid input", "constraint violation")
MAX_CONTENT, MAX_RAW = 500_000, 1_000_000


def exactly_one(df: DataFrame) -> DataFrame:
    """The only row; any other number of rows is an error when the result is read, however it is read."""
    all_ = df.limit(2).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    checked = F.when(F.size("rows") == 1, F.col("rows")).otherwise(F.raise_error(F.lit("expected one row")))
    return all_.select(F.inline(checked))


def sitemap_diff(entries: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """url, take: unknown; failed at least a day ago; or, where both dates are known, changed since."""
    e = entries.join(pages, "url", "left")
    take = F.when(F.col("status").isNull(), True).when(F.col("status") == "failed", F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") <= now - F.expr("INTERVAL 24 HOURS"))).when(F.col("lastmod").isNotNull() & F.col("sitemap_lastmod").isNotNull(), F.col("lastmod") > F.col("sitemap_lastmod")).otherwise(True)
    return e.select("url", take.alias("take"))


def fetch_outcome(status: Column, attempt: Column, retry_after: Column, limit: int = 3) -> Column:
    """What to do after a response: outcome (modified, not_modified, retry, error) and wait_ms before the next try.

    The next try waits five seconds for each try it makes it; after 429 also what the server asks for, else 30 s.
    """
    again = (status == 429) | (status >= 500) | ((status < 400) & ~status.isin(200, 304))
    outcome = F.when(status == 304, "not_modified").when(status == 200, "modified").when(again & (attempt < limit), "retry").otherwise("error")
    wait = F.when(again & (attempt < limit), (attempt + 1) * 5000 + F.when(status == 429, F.coalesce(retry_after * 1000, F.lit(30_000))).otherwise(0)).otherwise(0)
    return F.struct(outcome.alias("outcome"), wait.cast("long").alias("wait_ms"))


def request_headers(etag: Column, modified: Column) -> Column:
    """Conditional headers of a request for a page that was fetched before; only those known."""
    entries = F.array(F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), modified.alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def retry_delay(attempt: Column, base: int = 1000, most: int = 30_000) -> Column:
    """Milliseconds before try attempt + 1: doubling, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt - 1), F.lit(most)).cast("long")


def is_final(code: Column, message: Column) -> Column:
    """Errors that no further try can mend."""
    low, hit = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(code, F.lit("")).isin(*FINAL_CODES)
    for m in FINAL_MESSAGES:
        hit = hit | F.contains(low, F.lit(m))
    return hit


def robots_rules(text: Column) -> Column:
    """disallow and allow paths of a robots file, lower-cased, whatever agent they are for."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.lower(F.trim(F.regexp_replace(l, r"\s+", " "))))
    of = lambda name: F.filter(F.transform(F.filter(lines, lambda l: l.startswith(f"{name}:")), lambda l: F.trim(F.substring(l, len(name) + 2, 1_000_000))), lambda p: p != "").alias(name)
    return F.struct(of("disallow"), of("allow"))


def robots_allowed(path: Column, disallow: Column, allow: Column) -> Column:
    """A matching disallow rule blocks unless some allow rule matches; rules are lower-cased, paths are not."""
    hit = lambda rules: F.exists(rules, lambda r: (r != "") & path.startswith(F.lower(r)))
    return ~hit(disallow) | hit(allow)


def frontier(links: DataFrame, known: DataFrame, keys: list[str], per_page: int = 50, page: str = "src") -> DataFrame:
    """Links not crawled yet, at most per_page of each page in order of their url."""
    new = links.distinct().join(known.select(*keys).distinct(), keys, "left_anti")
    return new.withColumn("rn", F.row_number().over(Window.partitionBy(page).orderBy(keys[-1]))).where(F.col("rn") <= per_page).drop("rn")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """node, depth: first depth at which each node is reached from the seeds, up to max_depth joins."""
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    last = seen
    for d in range(1, max_depth + 1):
        step = edges.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        last = cut(step)  # each level is computed once
        seen = seen.unionByName(last)
    return seen


def schedule(jobs: DataFrame, domain: str, time: str, key: str, per: int = 5, seconds: int = 60) -> DataFrame:
    """Start second of each job when a domain takes `per` jobs each `seconds`, by time and then key.

    Jobs are ranked within a domain's days and days by their counts, so a large domain is not one task's.
    """
    day = F.to_date(time)
    parts = jobs.groupBy(F.col(domain).alias("__d"), day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__d").orderBy(F.col("__day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__d", "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = jobs.withColumn("__day", day).withColumn("__rank", F.row_number().over(Window.partitionBy(domain, "__day").orderBy(time, key)) - 1)
    both = ranked.join(parts.withColumnRenamed("__day", "__at"), F.col(domain).eqNullSafe(F.col("__d")) & F.col("__day").eqNullSafe(F.col("__at")))
    return both.withColumn("start_s", (F.floor((F.col("__before") + F.col("__rank")) / per) * seconds).cast("long")).select(*jobs.columns, "start_s")


def publish(links: DataFrame, max_depth: int = 3) -> DataFrame:
    """Crawl jobs of new links (url, source_id, depth of the page that has them), one level deeper; none at the end."""
    depth = F.coalesce("depth", F.lit(0))
    return links.where(F.col("depth").isNull() | (F.col("depth") < max_depth)).select(F.lit("crawl").alias("type"), "url", "source_id", (depth + 1).cast("int").alias("depth"), F.lit(max_depth).alias("max_depth"))


def publish_batch(urls: DataFrame) -> DataFrame:
    """Crawl jobs of urls (url, source_id) without a depth."""
    return urls.select(F.lit("crawl").alias("type"), "url", "source_id")


def slice_of(urls: DataFrame, done: int, size: int = 50) -> DataFrame:
    """The next size urls in order, with the number left after them and whether there are any."""
    n = urls.agg(F.count(F.lit(1)).alias("__n"))
    part = urls.orderBy(*urls.columns).offset(done).limit(size)
    left = F.greatest(F.col("__n") - (done + size), F.lit(0))
    return part.crossJoin(F.broadcast(n)).select(*urls.columns, left.alias("remaining"), (left > 0).alias("has_more"))


def continuation(path: Column, position: Column, more: Column, seconds: int = 30) -> Column:
    """The follow-up job of a run that stopped at a position; null where nothing is left."""
    return F.when(more, F.struct(F.concat(path, F.lit("?offset="), position.cast("string")).alias("url"), F.lit(seconds).alias("delay_s"), F.lit(0).alias("retries")))


def enqueue(chunks: DataFrame, now: Column, priority: str = "normal") -> DataFrame:
    """Pending embedding jobs of chunks (document_id, chunk_id, chunk_text)."""
    name = F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_id").cast("string"), F.unix_millis(now).cast("string"))
    return chunks.select(name.alias("id"), "document_id", "chunk_id", "chunk_text", F.lit(priority).alias("priority"), now.alias("created_at"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit("pending").alias("status"))


def process(jobs: DataFrame, ok: Column, message: Column, now: Column, most: int = 3) -> DataFrame:
    """Jobs after a run of the pending ones: completed where ok, else retried or failed; others as they are."""
    pending, failed = F.col("status") == "pending", after_failure(message, F.col("attempts"), most)
    status = F.when(~pending, F.col("status")).when(ok, "completed").otherwise(failed["status"])
    attempts = F.when(pending & ~ok, failed["attempts"]).otherwise(F.col("attempts"))
    done = F.when(pending & (status != "pending"), now).otherwise(F.col("processed_at"))
    return jobs.withColumns({"status": status, "attempts": attempts.cast("int"), "processed_at": done})


def of_document(jobs: DataFrame, document) -> DataFrame:
    """The pending jobs of one document."""
    return jobs.where((F.col("document_id") == document) & (F.col("status") == "pending"))


def queue_head(queue: DataFrame, k: int, semantic_priority: bool = False) -> DataFrame:
    """Next pending jobs. Priorities sort as text, descending (normal, low, high), unless their meaning is asked for."""
    p = F.expr("case priority when 'high' then 2 when 'normal' then 1 else 0 end") if semantic_priority else F.col("priority")
    return queue.where("status = 'pending'").orderBy(p.desc(), "created_at", "id").limit(k)


def after_failure(message: Column, attempts: Column, most: int = 3) -> Column:
    """State after a failed job: retried while its message is transient and tries are left; the last try is not counted."""
    again = message.rlike(RETRY) & (attempts + 1 < most)
    return F.struct(F.when(again, "pending").otherwise("failed").alias("status"), F.when(again, attempts + 1).otherwise(attempts).alias("attempts"))


def cleanup(queue: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows left, number removed) of completed jobs strictly older than days."""
    old = (F.col("status") == "completed") & (F.col("processed_at") < now - F.make_dt_interval(F.lit(days)))
    old = F.coalesce(old, F.lit(False))
    return queue.where(~old), queue.agg(F.count_if(old).alias("removed"))


def child_view(children: DataFrame, parents: DataFrame, key: str, parent_key: str, user_id) -> DataFrame:
    """Children of parents that the caller owns."""
    own = parents.where(F.col("user_id") == user_id).select(F.col(parent_key).alias(key))
    return children.join(own, key, "left_semi")


def without_plan(users: DataFrame, plans: DataFrame) -> DataFrame:
    return users.join(plans.select("user_id"), "user_id", "left_anti")


def usage(plans: DataFrame, now: Column) -> DataFrame:
    """Plans after cycles that ended are reset, and whether a message may be sent."""
    over = F.col("cycle_end") < now
    used = F.when(over, F.lit(0)).otherwise(F.col("messages_used"))
    end = F.when(over, now + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("cycle_end"))
    return plans.select("user_id", used.alias("messages_used"), end.alias("cycle_end"), (used < F.col("messages_limit")).alias("can_send"))


def increment(plans: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Plans after cycles are reset and messages counted; asked has (user_id, messages, tokens), each user once."""
    over = F.col("cycle_end") < now
    p = plans.join(asked, "user_id", "left")
    used = F.when(over, F.lit(0)).otherwise(F.col("messages_used")) + F.coalesce("messages", F.lit(0))
    tokens = F.when(over, F.lit(0)).otherwise(F.col("tokens_used")) + F.coalesce("tokens", F.lit(0))
    return p.select("user_id", used.cast("long").alias("messages_used"), tokens.cast("long").alias("tokens_used"), "messages_limit", F.when(over, now + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("cycle_end")).alias("cycle_end"))


def usage_json() -> Column:
    """What a caller is told of a plan."""
    return F.to_json(F.struct("messages_used", "messages_limit", "tokens_used"))


def with_triggers(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """new rows as they are stored over old ones: updated_at is now for changed rows, trust_level is set for inserted
    rows and for those whose document_type changes, else it stays."""
    o = old.select(key, F.col("document_type").alias("__type"), F.col("trust_level").alias("__trust"))
    fresh = F.col("__type").isNull() | (F.col("__type") != F.col("document_type"))
    return new.join(o, key, "left").withColumn("trust_level", F.when(fresh, trust_level(F.col("document_type"))).otherwise(F.col("__trust"))).withColumn("updated_at", now).drop("__type", "__trust")


def existing_document(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages (url, content_hash) with the id of the crawled document of that address and content, if there is one; of
    several the smallest."""
    d = documents.where("document_type = 'gov_crawled'").groupBy(F.col("source_url").alias("url"), "content_hash").agg(F.min("id").alias("document_id"))
    return pages.join(d, ["url", "content_hash"], "left")


def within_limits(documents: DataFrame, content: str = "content", raw: str = "raw_content") -> Column:
    """Whether a document is small enough to be stored: at most twice the limits."""
    return (F.coalesce(F.length(content), F.lit(0)) <= 2 * MAX_CONTENT) & (F.coalesce(F.length(raw), F.lit(0)) <= 2 * MAX_RAW)


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, rows refused for their size)."""
    fits = within_limits(new)
    return upsert(old, new.where(fits), keys, version), new.where(~fits)


def touch_cache(cache: DataFrame, asked: DataFrame, key: str = "query_key") -> DataFrame:
    """The query cache after asked (key, query): known keys count one hit for each time, new ones begin with theirs."""
    n = asked.groupBy(key).agg(F.count(F.lit(1)).alias("__hits"))
    hits = F.coalesce("hit_count", F.lit(0)) + F.coalesce("__hits", F.lit(0))
    return cache.select(key, "hit_count").join(n, key, "full_outer").select(key, hits.alias("hit_count"))


def refresh(documents: DataFrame, mode: str = "stale", document=None) -> DataFrame:
    """Documents whose embeddings are made anew: one (whatever its state), all stale ones, or, forced, one whose hash
    is set to null so that nothing skips it."""
    if mode == "stale":
        return documents.where(stale(F.col("updated_at"), F.col("embedded_at")))
    one = documents.where(F.col("id") == document)
    return one.withColumn("content_hash", F.lit(None).cast("string")) if mode == "force" else one


def trust_level(document_type: Column) -> Column:
    return F.when(document_type == "gov_crawled", F.lit("1.00")).otherwise(F.lit("0.70")).cast("decimal(3,2)")


def stale(updated_at: Column, embedded_at: Column) -> Column:
    return F.when(embedded_at.isNull(), True).when(updated_at.isNull(), False).otherwise(updated_at > embedded_at)


def sync_actions(new: DataFrame, old: DataFrame, keys: list[str], hash_col: str = "chunk_hash") -> DataFrame:
    """keep, update, insert or delete for each chunk place of either side."""
    n, o = new.select(*keys, F.col(hash_col).alias("new_hash")), old.select(*keys, F.col(hash_col).alias("old_hash"))
    act = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").when(F.col("new_hash") == F.col("old_hash"), "keep").otherwise("update")
    return n.join(o, keys, "full_outer").select(*keys, act.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, that of the greatest version, new rows before old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    cols = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(version, "__new")).alias("__row"))
    return best.select(*keys, "__row.*").select(*old.columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in new are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_status(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Statuses of known urls are set; unknown urls are ignored."""
    c = changes.groupBy("url").agg(F.max("status").alias("__s"))  # several changes of one url do not repeat its page
    return pages.join(c, "url", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def get_or_create(folders: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Folders with a row for each wanted name; new ids are hashes of the name."""
    new = wanted.select(key).distinct().join(folders.select(key), key, "left_anti").withColumn("id", F.sha2(F.col(key), 256))
    return folders.unionByName(new, allowMissingColumns=True)


def audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, violations: one pass over rows for all rules (a null outcome violates)."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counted.unpivot([], list(checks), "rule", "violations")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a UNIQUE rule, with their number of rows; nulls never do."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
