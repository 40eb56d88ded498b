"""The task report: links in events, pull requests and who opened them, and the task that each event belongs to."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.filters import in_period, own_commits
from weftline.operators.people import by_people, of_direction, resolved_names
from weftline.operators.timeline import as_of, nearest_cited
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.events import BROWSER, GIT, TEAMS, filled, meta

INHERIT_MINUTES, CREATE_MINUTES, PROBABLE_MINUTES, HISTORY_DAYS = 20, 15, 120, 90
#: Links of common trackers; all groups of a pattern together are the task's key, the last one its identifier.
TASK_PATTERNS = (
    (r"atlassian\.net/browse/([A-Z][A-Z0-9]+-\d+)", 1),
    (r"linear\.app/[\w-]+/issue/([A-Z][A-Z0-9]+-\d+)", 1),
    (r"github\.com/([\w.-]+/[\w.-]+)/issues/(\d+)", 2),
    (r"dev\.azure\.com/[\w.-]+/[\w.%-]+/_workitems/edit/(\d+)", 1),
)


@dataclass(frozen=True)
class CodeHost:
    """Pages of pull requests (repository, number) and pages where one is opened (repository)."""

    page: str
    create: str


#: The pages of common code hosts.
HOSTS = (
    CodeHost(r"^https://github\.com/([\w.-]+/[\w.-]+)/pull/(\d+)(?:[/?#].*)?$", r"^https://github\.com/([\w.-]+/[\w.-]+)/compare/"),
    CodeHost(r"^https?://([\w.-]+(?:/[\w.-]+)+?)/-/merge_requests/(\d+)(?:[/?#].*)?$", r"^https?://([\w.-]+(?:/[\w.-]+)+?)/-/merge_requests/new"),
    CodeHost(r"^https://bitbucket\.org/([\w.-]+/[\w.-]+)/pull-requests/(\d+)(?:[/?#].*)?$", r"^https://bitbucket\.org/([\w.-]+/[\w.-]+)/pull-requests/new"),
    CodeHost(r"^https://dev\.azure\.com/([\w.-]+/[\w.%-]+/_git/[\w.%-]+)/pullrequest/(\d+)(?:[/?#].*)?$", r"^https://dev\.azure\.com/([\w.-]+/[\w.%-]+/_git/[\w.%-]+)/pullrequestcreate"),
)


def link_text() -> Column:
    """The text of an event that links are read from."""
    return F.coalesce(F.when(F.col("source") == BROWSER, meta("url")).otherwise(F.col("content")), F.lit(""))


def task_refs(text: Column, patterns=TASK_PATTERNS) -> Column:
    """ARRAY of (key, id) of the tasks a text links to, in order of pattern and place."""
    found = []
    for pattern, groups in patterns:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
        keys = parts[0] if groups == 1 else reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit("/"), y)), parts)
        found.append(F.zip_with(keys, parts[-1], lambda k, i: F.struct(k.alias("key"), i.alias("id"))))
    return F.array_distinct(F.concat(*found))


def pr_refs(text: Column, hosts=HOSTS) -> Column:
    """ARRAY of (repo, number) of the pull requests a text links to, in the order of its links."""
    def read(link: Column) -> Column:
        return F.coalesce(*(F.when(link.rlike(host.page), F.struct(F.regexp_extract(link, host.page, 1).alias("repo"), F.regexp_extract(link, host.page, 2).cast("int").alias("number"))) for host in hosts))

    return F.filter(F.transform(X.url_tokens(text), read), lambda pr: pr.isNotNull())


def created_in(url: Column, hosts=HOSTS) -> Column:
    """Which repository a visited form for a new pull request belongs to, if the page is one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, host.create, 1), F.lit("")) for host in hosts))


#: What code hosts put before and behind the title of a pull request.
TITLE_PARTS = (r"^Pull Request \d+:\s*", r"\s+by\s+\S+\s+·.*$", r"\s+(·|\(!\d+\)|-\s+Repos).*$")


def pr_title(title: Column) -> Column:
    """What somebody named a pull request, read from the title of its page."""
    for part in TITLE_PARTS:
        title = F.regexp_replace(title, part, "")
    return F.trim(title)


def cites(title: Column, identifier: Column) -> Column:
    """True where an identifier stands in a title and neither letter nor digit touches it."""
    escaped = F.regexp_replace(identifier, r"([^\p{L}\p{N}])", r"\\$1")
    return F.regexp_like(title, F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}])"), escaped, F.lit(r"($|[^\p{L}\p{N}])")))


def pull_requests(history: DataFrame, patterns=TASK_PATTERNS, hosts=HOSTS, key: str = "record_id") -> DataFrame:
    """repo, number, title, opened_at, opened_by_me, mentioned_by_me, task_key (linked exactly) of every pull request seen."""
    seen = history.where("occurred_at is not null").select(
        key, "occurred_at", (F.col("source") == BROWSER).alias("visit"), (meta("sent_by_me") == "true").alias("mine"), pr_title(F.coalesce(meta("title"), F.lit(""))).alias("title"),
        task_refs(F.coalesce("content", F.lit("")), patterns).alias("tasks"), F.explode(pr_refs(link_text(), hosts)).alias("pr"),
    )
    single = F.when(~F.col("visit") & (F.size(F.array_distinct(F.transform("tasks", lambda t: t["key"]))) == 1), F.col("tasks")[0]["key"])
    order = F.struct("occurred_at", key)
    found = seen.groupBy("pr.repo", "pr.number").agg(
        F.min(F.when(F.col("visit"), F.col("occurred_at"))).alias("first_seen"),
        F.max_by(F.when(F.col("visit"), F.nullif("title", F.lit(""))), F.when(F.col("visit") & (F.col("title") != ""), order)).alias("title"),
        F.min(F.when(~F.col("visit") & F.col("mine"), F.col("occurred_at"))).alias("mentioned_at"),
        F.min_by(single, F.when(single.isNotNull(), order)).alias("task_key"),
    )
    pages = history.where((F.col("source") == BROWSER) & F.col("occurred_at").isNotNull()).select(created_in(F.coalesce(meta("url"), F.lit("")), hosts).alias("repo"), F.col("occurred_at").alias("created_at")).where("repo is not null")
    # visits and creation pages meet in bins of time as wide as the window
    width = CREATE_MINUTES * 60_000_000
    seen_at, made_at = F.unix_micros("first_seen"), F.unix_micros("created_at")
    first = found.where("first_seen is not null").select("repo", "number", "first_seen", F.explode(F.array(F.floor(seen_at / width), F.floor(seen_at / width) - 1)).alias("bin"))
    near = first.join(pages.withColumn("bin", F.floor(made_at / width)), ["repo", "bin"]).where((seen_at >= made_at) & (seen_at - made_at <= width))
    opened = near.select("repo", "number").distinct().withColumn("opened_by_me", F.lit(True))
    mine = found.join(opened, ["repo", "number"], "left").withColumn("opened_by_me", F.coalesce("opened_by_me", F.lit(False)))
    return mine.select("repo", "number", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("opened_by_me"), F.col("first_seen")).otherwise(F.col("mentioned_at")).alias("opened_at"), "opened_by_me", (~F.col("opened_by_me") & F.col("mentioned_at").isNotNull()).alias("mentioned_by_me"), "task_key")


def linked_pull_requests(prs: DataFrame, period: DataFrame, patterns=TASK_PATTERNS) -> DataFrame:
    """Pull requests with the task they belong to: linked exactly, else the only task whose identifier the title cites."""
    tasks = period.select(F.explode(task_refs(link_text(), patterns)).alias("t")).select("t.key", "t.id").distinct()
    # titles meet identifiers on their tokens, then the whole identifier is checked
    titled = prs.where("task_key is null and title <> ''").select("repo", "number", "title", F.explode(F.array_distinct(X.word_tokens(F.col("title")))).alias("token"))
    named = tasks.withColumn("token", F.element_at(X.word_tokens(F.col("id")), -1))
    met = titled.join(named, "token").where(cites(F.col("title"), F.col("id"))).groupBy("repo", "number").agg(F.min("key").alias("cited"), F.count_distinct("key").alias("n")).where("n = 1")
    return cut(prs.join(met.select("repo", "number", "cited"), ["repo", "number"], "left").withColumn("task_key", F.coalesce("task_key", "cited")).drop("cited"))


def assigned(period: DataFrame, linked: DataFrame, patterns=TASK_PATTERNS, hosts=HOSTS, key: str = "record_id") -> DataFrame:
    """Events with `cited` (all task keys linked directly) and `task` (direct, else inherited from the nearest one)."""
    told = period.where("occurred_at is not null").withColumn("cited", F.transform(task_refs(link_text(), patterns), lambda t: t["key"])).withColumn("us", F.unix_micros("occurred_at"))
    via = told.select(key, F.posexplode(pr_refs(link_text(), hosts)).alias("at", "pr")).join(small_side(linked.where("task_key is not null").select(F.struct("repo", "number").alias("pr"), "task_key")), "pr").groupBy(key).agg(F.min_by("task_key", "at").alias("via"))
    direct = told.join(via, key, "left").withColumn("direct", F.coalesce(F.get("cited", F.lit(0)), "via")).drop("via")
    return nearest_cited(direct, F.col("direct"), INHERIT_MINUTES, at="us", key=key).withColumnRenamed("near", "task")


def touched(period: DataFrame, linked: DataFrame, patterns=TASK_PATTERNS, hosts=HOSTS, key: str = "record_id") -> DataFrame:
    """Events of tasks, once for each task (`one`) that they belong to or cite."""
    told = assigned(period, linked, patterns, hosts, key).where("task is not null")
    return told.withColumn("one", F.explode(F.array_distinct(F.concat(F.array("task"), "cited"))))


def history_of(events: DataFrame, period_end, days: int = HISTORY_DAYS) -> DataFrame:
    """The past that pull requests of a period are looked for in: so many days, without other people's commits."""
    return events.where(in_period(period_end - timedelta(days=days), period_end) & own_commits())


def report(period: DataFrame, history: DataFrame, period_end, patterns=TASK_PATTERNS, hosts=HOSTS, key: str = "record_id") -> DataFrame:
    """task, title, first_at, n_events, n_prs, status, involvement, in order of first touch."""
    linked = linked_pull_requests(pull_requests(history, patterns, hosts, key), period, patterns)
    every = cut(touched(period, linked, patterns, hosts, key).select(key, "source", "occurred_at", "us", "metadata", "cited", "one"))
    direct = F.array_contains("cited", F.col("one"))
    own = (F.col("source") == TEAMS) & (meta("sent_by_me") == "true") | (F.col("source") == GIT) & (F.coalesce(meta("authorship"), F.lit("")) != "other")
    level = F.when(direct & own, 2).when(direct & (F.col("source") == BROWSER), 1).otherwise(0)
    titled = (F.col("source") == BROWSER) & direct & filled(meta("title")).isNotNull()
    tasks = every.groupBy(F.col("one").alias("task")).agg(
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("n_events"),
        F.max_by(F.when(titled, meta("title")), F.when(titled, F.struct("us", key))).alias("title"), F.max(level).alias("level"),
    )
    candidates = linked.where((F.col("opened_by_me") | F.col("mentioned_by_me")) & (F.col("opened_at") < F.lit(period_end)))
    exact = candidates.where("task_key is not null").select("repo", "number", "task_key", "opened_by_me")
    loose = candidates.where("task_key is null").select("repo", "number", "opened_by_me", F.unix_micros("opened_at").alias("opened_us"))
    # the task touched last before the request was opened: merged by time, no pairs
    last = every.groupBy("us").agg(F.max("one").alias("value")).withColumn("_all", F.lit(0))
    guessed = as_of(loose.withColumnRenamed("opened_us", "us").withColumn("_all", F.lit(0)), last, "_all", PROBABLE_MINUTES).where("found is not null").select("repo", "number", F.col("found").alias("task_key"), "opened_by_me")
    prs = exact.unionByName(guessed).groupBy(F.col("task_key").alias("task")).agg(F.count("*").alias("n_prs"), F.max("opened_by_me").alias("opened"))
    joined = tasks.join(prs, "task", "left")
    involvement = F.when(F.coalesce("opened", F.lit(False)) | (F.col("level") == 2), "mine").when(F.col("level") == 1, "consulted").otherwise("mentioned_by_others")
    return joined.select("task", F.coalesce("title", F.lit("")).alias("title"), "first_at", "n_events", F.coalesce("n_prs", F.lit(0)).alias("n_prs"), F.when(F.col("n_prs") > 0, "done").otherwise("in_progress").alias("status"), involvement.alias("involvement")).orderBy("first_at", "task")


def cited_by(tasks: DataFrame, events: DataFrame, patterns=TASK_PATTERNS) -> DataFrame:
    """Tasks that some of the events link to."""
    keys = events.select(F.explode(task_refs(link_text(), patterns)).alias("t")).select(F.col("t.key").alias("task")).distinct()
    return tasks.join(keys, "task", "left_semi")


def of_status(tasks: DataFrame, status: str = "") -> DataFrame:
    """Tasks that are `done` or `in_progress`; all where neither is asked."""
    return tasks.where(F.col("status") == status) if status in ("done", "in_progress") else tasks


def matching(tasks: DataFrame, told: DataFrame, linked: DataFrame, people: list[str] = (), way: str = "any", topic: str = "", patterns=TASK_PATTERNS, key: str = "record_id") -> DataFrame:
    """Tasks that messages of the people and direction cite, and that speak of the topic. `told`: see `touched`.

    A name that names nobody is looked for as a topic. A topic may stand in a task's key or title, in its pull requests or events.
    """
    found = resolved_names(told, list(people), way, key) if people else {}
    known, terms = [form for form in found.values() if form], [name for name, form in found.items() if not form] + ([topic] if topic else [])
    if known or way != "any":
        messages = told.where((F.col("source") == TEAMS) & of_direction(way))
        tasks = cited_by(tasks, by_people(messages, known, way, key) if known else messages, patterns)
    if not terms:
        return tasks
    spoken = lambda text: [F.max(F.contains(X.fold(text), X.fold(F.lit(term)))).alias(f"_{i}") for i, term in enumerate(terms)]
    texts = told.select(F.col("one").alias("task"), F.col("content").alias("said")).unionByName(linked.where("task_key is not null").select(F.col("task_key").alias("task"), F.concat_ws("\n", F.concat_ws("#", "repo", F.col("number").cast("string")), "title").alias("said")))
    texts = texts.unionByName(tasks.select("task", F.concat_ws("\n", "task", "title").alias("said")))
    met = texts.groupBy("task").agg(*spoken(F.coalesce("said", F.lit(""))))
    every = reduce(lambda a, b: a & b, (F.col(f"_{i}") for i in range(len(terms))))
    return tasks.join(met.where(every).select("task"), "task", "left_semi")


def unassigned(told: DataFrame) -> DataFrame:
    """One row: events and how many of them belong to no task."""
    return told.agg(F.count("*").alias("events"), F.count_if(F.col("task").isNull()).alias("unassigned"))
