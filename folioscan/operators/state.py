"""Reader state: last-write-wins merges, tombstones, library, progress, shelves, notes, history.

State is a log of records, each with ``updated_at`` in milliseconds and perhaps ``deleted``; the
latest record of a key is its state. Equal times go to the local side, then to the later of one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

TABLES = {"progress": "paper_id", "library": "paper_id", "collections": "id", "highlights": "id", "notes": "paper_id", "saved_searches": "id", "reading_units": "id"}
TOMBSTONE_MS = 90 * 24 * 60 * 60 * 1000
HISTORY = 60
STARTED, FINISHED, SHELVED = 0.02, 0.95, 0.97


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("deleted", F.lit(False)))


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of state changes made of the ``events`` table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 2 == 0).alias("is_local"),
        (F.col("event_type") == "error").alias("deleted"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"),
        "event_type",
        "value",
    )


def latest(log: DataFrame, key: str = "paper_id", order=("updated_at", "is_local", "seq")) -> DataFrame:
    """The winning record of each key: one aggregate, whose partial results keep hot keys small."""
    return log.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def merge(local: DataFrame, remote: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Both sides' records by key, the later winning and ties going to the local one.

    Repeats within the remote side: its last by ``seq`` stands, whatever its time; within the local
    side the latest, then the last. Without ``seq`` a side has a key once.
    """
    number = F.col(seq) if seq else F.lit(0)
    last = remote.withColumn("_s", number).groupBy(key).agg(F.max_by(F.struct("*"), F.col("_s")).alias("r")).select("r.*")
    sides = local.withColumn("_s", number).withColumn("_l", F.lit(1)).unionByName(last.withColumn("_l", F.lit(0)), allowMissingColumns=True)
    return latest(sides, key, ("updated_at", "_l", "_s")).drop("_s", "_l")


def put(rows: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Rows with changes put over them by key, whatever their times; of repeats in the changes the last by ``seq`` stands."""
    number = F.col(seq) if seq else F.lit(0)
    sides = rows.withColumn("_s", F.lit(0).cast("long")).withColumn("_l", F.lit(0)).unionByName(changes.withColumn("_s", number.cast("long")).withColumn("_l", F.lit(1)), allowMissingColumns=True)
    return latest(sides, key, ("_l", "_s")).drop("_s", "_l")


def normalise(spark: SparkSession, document: dict | None, schemas: dict) -> dict:
    """A state document with all seven tables: absent ones are empty, an absent time is 0, settings stay as they are."""
    given = document or {}
    tables = {n: given[n] if given.get(n) is not None else spark.createDataFrame([], schemas[n]) for n in TABLES}
    return tables | {"schema": 1, "updated_at": given.get("updated_at") or 0, "settings": given.get("settings")}


def import_document(spark: SparkSession, local: dict, incoming: dict | None, schemas: dict) -> dict:
    """Local state with an incoming document put over it: nothing is cleared, and settings are not taken."""
    mine, theirs = normalise(spark, local, schemas), normalise(spark, incoming, schemas)
    return mine | {name: put(mine[name], theirs[name], key) for name, key in TABLES.items()}


def merge_documents(local: dict, remote: dict) -> dict:
    """Merge whole state documents: seven tables by their keys; a missing table is empty."""
    out = {}
    for name, key in TABLES.items():
        a, b = local.get(name), remote.get(name)
        out[name] = merge(a, b, key) if a is not None and b is not None else a if a is not None else b
    one, two = local.get("settings") or {}, remote.get("settings") or {}
    out["settings"] = (one if one.get("updated_at", 0) >= two.get("updated_at", 0) else two) or None
    out["updated_at"] = max(local.get("updated_at", 0), remote.get("updated_at", 0))
    return out


def prune(rows: DataFrame, now_ms: int, ttl_ms: int = TOMBSTONE_MS) -> DataFrame:
    """Without tombstones that are ``ttl_ms`` old or older."""
    return rows.filter(~F.coalesce("deleted", F.lit(False)) | (F.lit(now_ms) - F.col("updated_at") < ttl_ms))


def record_count(document: dict) -> int:
    """Records of all tables, tombstones included."""
    return sum(document[name].count() for name in TABLES if document.get(name) is not None)


def normal_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.transform(tags, lambda t: F.lower(F.trim(t))), "")))


def upsert(entries: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Library entries after changes (paper_id, and any of status, starred, collection_ids, tags; null leaves a value).

    A change revives a deleted entry with default values.
    """
    old = entries.alias("o").join(changes.alias("c"), "paper_id", "full")
    known = F.col("o.updated_at").isNotNull() & ~F.coalesce("o.deleted", F.lit(False))
    changed = F.col("c.changed")
    empty = F.expr("cast(array() as array<string>)")
    value = lambda name, default: F.when(changed, F.coalesce(F.col(f"c.{name}"), F.when(known, F.col(f"o.{name}")), default)).otherwise(F.col(f"o.{name}")).alias(name)
    return old.select(
        "paper_id",
        value("status", F.lit("unread")),
        value("starred", F.lit(False)),
        value("collection_ids", empty),
        F.when(changed & F.col("c.tags").isNotNull(), normal_tags(F.col("c.tags"))).when(changed, F.coalesce(F.when(known, F.col("o.tags")), empty)).otherwise(F.col("o.tags")).alias("tags"),
        F.when(changed & ~known, F.lit(now_ms)).otherwise(F.col("o.added_at")).alias("added_at"),
        F.when(changed, F.lit(now_ms)).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(changed, F.lit(False)).otherwise(F.coalesce("o.deleted", F.lit(False))).alias("deleted"),
    )


def toggle(entries: DataFrame, paper_ids: DataFrame, now_ms: int) -> DataFrame:
    """Bookmarks switched: entries that live get a tombstone, the others begin anew."""
    asked = paper_ids.select("paper_id").distinct().withColumn("changed", F.lit(True))
    alive = entries.join(asked, "paper_id", "left").filter(F.col("changed") & ~F.coalesce("deleted", F.lit(False))).select("paper_id")
    gone = entries.join(alive, "paper_id", "left_semi").withColumn("deleted", F.lit(True)).withColumn("updated_at", F.lit(now_ms))
    fresh = asked.join(alive, "paper_id", "left_anti")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("status", "string"), ("starred", "boolean"), ("collection_ids", "array<string>"), ("tags", "array<string>"))]
    return upsert(entries.join(alive, "paper_id", "left_anti"), fresh.select("*", *none), now_ms).unionByName(gone.select("paper_id", "status", "starred", "collection_ids", "tags", "added_at", "updated_at", "deleted"))


def create_collection(collections: DataFrame, collection_id: str, name: str, color: str, now_ms: int) -> DataFrame:
    """Collections with a new one, placed after those that live; a blank name becomes ``Untitled collection``."""
    # One row: the count of what lives.
    row = live(collections).agg(F.count("id").alias("order")).select(
        F.lit(collection_id).alias("id"), named(F.lit(name), F.lit("Untitled collection")).alias("name"), F.lit(color).alias("color"), "order",
        F.lit(now_ms).cast("long").alias("created_at"), F.lit(now_ms).cast("long").alias("updated_at"), F.lit(False).alias("deleted"),
    )
    return collections.unionByName(row, allowMissingColumns=True)


def rename_collection(collections: DataFrame, collection_id: str, name: str, now_ms: int) -> DataFrame:
    """Collections with one renamed; a blank name leaves it, an unknown one changes nothing."""
    it = F.col("id") == collection_id
    return collections.withColumn("name", F.when(it, named(F.lit(name), F.col("name"))).otherwise(F.col("name"))).withColumn("updated_at", F.when(it, F.lit(now_ms)).otherwise(F.col("updated_at")))


def delete_collection(collections: DataFrame, entries: DataFrame, collection_id: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Collections with a tombstone for one, and entries without it."""
    it = F.col("id") == collection_id
    marked = collections.withColumn("deleted", F.when(it, F.lit(True)).otherwise(F.coalesce("deleted", F.lit(False)))).withColumn("updated_at", F.when(it, F.lit(now_ms)).otherwise(F.col("updated_at")))
    member = F.array_contains("collection_ids", collection_id)
    freed = entries.withColumn("updated_at", F.when(member, F.lit(now_ms)).otherwise(F.col("updated_at"))).withColumn("collection_ids", F.array_remove("collection_ids", collection_id))
    return marked, freed


def named(name: Column, otherwise: Column) -> Column:
    """A trimmed name, or another where that leaves nothing."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), otherwise)


def promoted(status: Column, percent: Column) -> Column:
    """The status that reading so far implies."""
    moved = F.when((percent > STARTED) & (status == "unread"), "reading").otherwise(status)
    return F.when((percent > FINISHED) & (status != "finished"), "finished").otherwise(moved)


def save_progress(progress: DataFrame, entries: DataFrame, moves: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(progress, entries) after moves (paper_id, percent, total, seq): a paper's last one stands as its progress.

    The furthest one moves the status of an entry that lives; papers without an entry get none.
    """
    last = moves.withColumn("updated_at", F.lit(now_ms).cast("long")).withColumn("deleted", F.lit(False))
    furthest = moves.groupBy("paper_id").agg(F.max("percent").alias("_far"))
    rows = entries.join(furthest, "paper_id", "left")
    to = promoted(F.col("status"), F.col("_far"))
    moved = F.col("_far").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & (to != F.col("status"))
    rows = rows.withColumn("updated_at", F.when(moved, F.lit(now_ms).cast("long")).otherwise(F.col("updated_at"))).withColumn("status", F.when(moved, to).otherwise(F.col("status")))
    return put(progress, last, "paper_id", "seq").drop("seq"), rows.select(*entries.columns)


def with_papers(rows: DataFrame, papers: DataFrame, *columns: str, cards: bool = False) -> DataFrame:
    """Rows of state by ``paper_id`` with columns of their papers, null for unknown ones; ``cards`` leaves these out."""
    known = papers.select(F.col("id").alias("paper_id"), *columns)
    return rows.join(known, "paper_id", "inner" if cards else "left")


def library_papers(entries: DataFrame, papers: DataFrame, progress: DataFrame, *columns: str, cards: bool = False) -> DataFrame:
    """Live entries with columns of their papers and the live progress, ``percent``, newest first."""
    read = live(progress).select("paper_id", "percent")
    return with_papers(live(entries).join(read, "paper_id", "left"), papers, *columns, cards=cards).orderBy(F.desc("added_at"), "paper_id")


def library(entries: DataFrame, status: str | None = None, starred: bool | None = None, collection: str | None = None, tag: str | None = None) -> DataFrame:
    """Live entries, newest first, that meet all conditions."""
    rows = live(entries)
    if status:
        rows = rows.filter(F.col("status") == status)
    if starred is not None:
        rows = rows.filter(F.col("starred") == starred)
    if collection:
        rows = rows.filter(F.array_contains("collection_ids", collection))
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    return rows.orderBy(F.desc("added_at"), "paper_id")


def tag_counts(entries: DataFrame) -> DataFrame:
    """(tag, count), the most used first, then by name in binary order."""
    return live(entries).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("tag").alias("count")).orderBy(F.desc("count"), "tag")


def shelf(progress: DataFrame, known: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """What to continue: of the latest ``3 * limit`` rows those unfinished and live, the first ``limit``.

    The first limit comes before the conditions, so the shelf may hold fewer.
    """
    rows = progress.orderBy(F.desc("updated_at"), F.desc("seq")).limit(3 * limit)
    rows = live(rows).filter(F.col("percent") < SHELVED)
    if known is not None:
        rows = rows.join(known, "paper_id")
    return rows.orderBy(F.desc("updated_at"), F.desc("seq")).limit(limit)


def mark_done(states: DataFrame, units: DataFrame, now_ms: int) -> DataFrame:
    """New rows for units (paper_id, key, label, ordinal) that aren't done yet; a first completion keeps its time."""
    old = live(states).select(F.col("paper_id"), F.col("key"), F.col("done").alias("_done"), F.col("completed_at").alias("_at"), F.col("rating").alias("_rating"))
    rows = units.join(old, ["paper_id", "key"], "left").filter(~F.coalesce("_done", F.lit(False)))
    return rows.select(F.concat("paper_id", F.lit("#"), "key").alias("id"), "paper_id", "key", "label", "ordinal", F.lit(True).alias("done"), F.col("_rating").alias("rating"), F.coalesce("_at", F.lit(now_ms)).alias("completed_at"), F.lit(now_ms).alias("updated_at"), F.lit(False).alias("deleted"))


def rate(states: DataFrame, ratings: DataFrame, now_ms: int) -> DataFrame:
    """New rows for ratings (paper_id, key, label, ordinal, rating): rated is done; a null rating clears one."""
    old = states.select("paper_id", "key", F.col("completed_at").alias("_at"))
    rows = ratings.join(old, ["paper_id", "key"], "left")
    return rows.select(F.concat("paper_id", F.lit("#"), "key").alias("id"), "paper_id", "key", "label", "ordinal", F.lit(True).alias("done"), "rating", F.coalesce("_at", F.lit(now_ms)).alias("completed_at"), F.lit(now_ms).alias("updated_at"), F.lit(False).alias("deleted"))


def revisits(states: DataFrame, limit: int = 50) -> DataFrame:
    """Units rated as not understood, the latest first."""
    return live(states).filter(F.col("rating").isin("fuzzy", "lost")).orderBy(F.desc("updated_at"), "id").limit(limit)


def revisit_papers(states: DataFrame, papers: DataFrame, limit: int = 12) -> DataFrame:
    """The latest units to revisit with their papers' titles, null for unknown papers."""
    return with_papers(revisits(states, limit), papers, "title").orderBy(F.desc("updated_at"), "id")


def collections_listed(collections: DataFrame) -> DataFrame:
    return live(collections).orderBy("order", "id")


def highlights_listed(highlights: DataFrame, paper_id: str | None = None) -> DataFrame:
    """One paper's highlights, the oldest first; or those of all papers, the newest first."""
    if paper_id is not None:
        return live(highlights).filter(F.col("paper_id") == paper_id).orderBy("created_at", "id")
    return live(highlights).orderBy(F.desc("created_at"), "id")


def searches_listed(searches: DataFrame) -> DataFrame:
    return live(searches).orderBy(F.desc("created_at"), "id")


def save_notes(notes: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Notes after changes (paper_id, body), one a paper: a blank body makes an existing note a tombstone, else nothing."""
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    known = notes.select("paper_id", F.lit(True).alias("_known"))
    rows = changes.join(known, "paper_id", "left").filter(~blank | F.col("_known")).select(
        "paper_id", F.when(blank, "").otherwise(F.col("body")).alias("body"), F.lit(now_ms).cast("long").alias("updated_at"), blank.alias("deleted")
    )
    return put(notes, rows, "paper_id")


def search_notes(notes: DataFrame, highlights: DataFrame, query: str, papers: DataFrame | None = None) -> DataFrame:
    """(source, paper_id, body, title): notes, then highlights, whose text holds the query in any case."""
    needle = query.strip().lower()
    if not needle:
        return notes.sparkSession.createDataFrame([], "source string, paper_id string, body string, title string")
    mine = live(notes).filter(F.contains(F.lower("body"), F.lit(needle))).select(F.lit("note").alias("source"), "paper_id", "body")
    quoted = F.concat(F.lit('"'), F.col("exact"), F.lit('"'))
    noted = F.coalesce("note", F.lit(""))
    body = F.when(noted != "", F.concat(noted, F.lit(" — "), quoted)).otherwise(quoted)
    marked = live(highlights).filter(F.contains(F.lower(F.concat(noted, F.lit(" "), "exact")), F.lit(needle))).select(F.lit("highlight").alias("source"), "paper_id", body.alias("body"))
    both = mine.unionByName(marked)
    if papers is None:
        return both.withColumn("title", F.lit(None).cast("string"))
    return both.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id", "left").select("source", "paper_id", "body", "title")


def history(searches: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(query, at): the latest ``keep`` different queries, trimmed, the latest first."""
    rows = searches.withColumn("query", F.trim("query")).filter(F.col("query") != "")
    return rows.groupBy("query").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "query").limit(keep)


def fill_gaps(base: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Each key's columns from the first of the frames, in order, that has the key."""
    frames = [f.withColumn("_order", F.lit(k)) for k, f in enumerate((base, *others))]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    first = both.groupBy(key).agg(F.min_by(F.struct("*"), F.col("_order")).alias("r"))
    return first.select("r.*").drop("_order")


def save_times(events: DataFrame, key: str = "key", at: str = "at", quiet: int = 900, most: int = 1200) -> DataFrame:
    """(key, saved_at): when a trailing debounce with a longest wait saves, of requests in milliseconds.

    A save takes the requests from a first one on, until none follows within the quiet period or ``most`` has passed.
    What a request would take, were it a first one, depends on the next ``2 * most`` milliseconds alone, so each stretch of
    time is a group of its own, of as many rows as it has different milliseconds. First ones are those after a quiet
    period, and those that follow a first one's requests: they are found by steps that double along these
    links. No task has all requests of a key, and none sorts them. Null keys or times request nothing.
    """
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at")).dropna().distinct()
    stretch = F.floor(F.col("at") / most)
    near = rows.select("key", "at", F.explode(F.sequence(stretch - 2, stretch + 1)).alias("stretch")).groupBy("key", "stretch").agg(F.array_sort(F.collect_list("at")).alias("ats"))

    def taken(t: Column) -> Column:
        """(at, opens, last, link): whether ``t`` follows a quiet period, its last request, and the next one if that comes soon after."""
        of = lambda low, high: F.filter("ats", lambda x: (x > low) & (x < high))
        last = F.aggregate(of(t, t + most), F.struct(t.alias("e"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"] | (x - a["e"] >= quiet), F.struct(a["e"], F.lit(True).alias("done"))).otherwise(F.struct(x.alias("e"), F.lit(False).alias("done"))))
        return F.struct(t.alias("at"), (F.size(of(t - quiet, t)) == 0).alias("opens"), last["e"].alias("last"))

    own = F.filter("ats", lambda t: F.floor(t / most) == F.col("stretch"))
    each = near.select("key", "ats", F.explode(F.transform(own, taken)).alias("r")).select("key", "ats", "r.*")
    link = F.array_min(F.filter("ats", lambda x: (x > F.col("last")) & (x < F.col("last") + quiet)))
    nodes = stored(each.select("key", "at", "opens", "last", link.alias("link")), "requests")
    firsts, links = nodes.filter("opens").select("key", "at"), nodes.filter("link is not null").select("key", "at", "link")
    while True:
        # Firsts hold all that fewer steps reach than a link now has; those a link away are added.
        reached = links.join(firsts, ["key", "at"], "left_semi").select("key", F.col("link").alias("at")).distinct()
        new = stored(reached.join(firsts, ["key", "at"], "left_anti"), "reached")
        if new.isEmpty():
            break
        firsts = stored(firsts.unionByName(new), "firsts")
        onward = links.select("key", F.col("at").alias("link"), F.col("link").alias("further"))
        links = stored(links.join(onward, ["key", "link"]).select("key", "at", F.col("further").alias("link")), "links")
    saved = F.least(F.col("last") + quiet, F.col("at") + most)
    return nodes.join(firsts, ["key", "at"], "left_semi").select("key", saved.alias("saved_at"))
